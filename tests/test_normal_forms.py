from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from lexiloom import queries
from lexiloom.functions import normalize
from lexiloom.plans import tokenization as tk
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["strip_marks", "nfc"])
def test_normalizing_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_normal_forms_are_those_of_pythons_tables(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)] + [chr(c) for c in (0x897, 0x113CE, 0x1612F, 0x1E5EE, 0x1DFA, 0x11384, 0x113BB, 0x113C2, 0x1611E, 0x16D67)]
    rng = random.Random(3)
    texts = ["".join(points[k : k + 256]) for k in range(0, len(points), 256)]
    texts += ["".join(rng.choice(rng.choice([points, marks, "aeoą가각"])) for _ in range(60)) for _ in range(1500)]
    texts += ["a" + c + m + "̧" for c in ("\U000105d2", "\U00011382", "\U00016d63", "o") for m in ("̇", "\U000113c9", "\U00016d67", "́")]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").repartition(4)
    got = df.select("t", *[normalize.normal_form(f)(F.col("t")).alias(f) for f in normalize.FORMS]).collect()
    assert len(got) == len(texts) + 2
    assert not [(r.t, f) for r in got for f in normalize.FORMS if r[f] != (r.t if r.t is None else unicodedata.normalize(f, r.t))]


def test_forms_between_python_functions_and_matches(spark):
    df = spark.createDataFrame([("é Å 7é",)], "t string")
    swap = normalize.PythonText(str.swapcase)
    plan = tk.UnicodeNormalizer(tk.SentenceFuncNormalizer(swap, tk.UnicodeNormalizer(tk.EachSplitTokenization(" "), "NFC")), "NFD")
    assert [t.x for t in df.select(tk.FlatTokenizer(plan).apply(F.col("t"), "sentence").alias("o")).first().o] == ["É", "å", "7É"]
    plan = tk.MatchTokenization(tk.UnicodeNormalizer(tk.EachSplitTokenization(" "), "NFD"), ["Å"])
    assert [t.x for t in df.select(tk.FlatTokenizer(plan).apply(F.col("t"), "sentence").alias("o")).first().o] == ["é", "Å", "7é"]


def test_few_texts_of_a_batch_are_python_objects_at_a_time():
    texts = [None if k % 7 == 0 else "é" * (k % 5) + str(k) for k in range(3 * normalize._AT_ONCE + 1)]
    want = [t and t.upper() for t in texts]
    assert normalize._leaves(str.upper, pa.array(texts)).to_pylist() == want
    pieces = pa.array([{"ismatch": k % 2 == 0, "x": t} for k, t in enumerate(texts)])
    assert [p["x"] for p in normalize._leaves(str.upper, pieces).to_pylist()] == [t if k % 2 == 0 else w for k, (t, w) in enumerate(zip(texts, want))]
    alive = most = 0

    class Counted(str):
        def __new__(cls, x):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            return super().__new__(cls, x)

        def __del__(self):
            nonlocal alive
            alive -= 1

    normalize._leaves(Counted, pa.array([str(k) for k in range(3 * normalize._AT_ONCE)]))
    assert most <= normalize._AT_ONCE + 1
