from __future__ import annotations

import math
import random

import brute
import pytest
from lexiloom.llm import quality_rules as qr
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, f int, `a.b` string"


def texts():
    rng = random.Random(5)
    say = lambda n, k=400: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(k)}" for _ in range(n))
    out = [say(80) for _ in range(20)] + [say(60, 3) for _ in range(10)] + ["w x y " * 40, "one two three " * 2 + say(60), "\n".join(["same line here"] * 30), say(49), say(50), "", None, " \t\n", "ü" * 70, "😺 $ # | <>" * 20]
    return out + [out[0], out[0], "a b c d " * 3000 + say(100)]


def test_counts_equal_brute_force(spark):
    rows = [(k if k else None, t, "en", 1, "x") for k, t in enumerate(texts())]
    got = qr.measured(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(((r[0], *brute.quality(r[1])) for r in rows), key=repr)


def test_windows_with_clashing_hashes(spark, monkeypatch):
    monkeypatch.setattr(qr, "_PLACE", 56)  # eight bits of hash are left
    rows = [(k, t, "en", 1, "x") for k, t in enumerate(texts())]
    got = {r.doc_id: r.n_repeat_words for r in qr.measured(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: brute.quality(r[1])[4] for r in rows}


def tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


@pytest.mark.parametrize("k, n", [(0, 217), (0, 300), (3, 800), (5, 400), (0, 0), (20, 5000)])
def test_binomial_tail(spark, k, n):
    got = spark.range(1).select(qr.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
    assert got == pytest.approx(1.0 if k > n * 0.02 else tail(k, n, 0.02))


def labelled(spark, n=700, bad=60):
    rng = random.Random(6)
    say = lambda mark: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}{mark}" for _ in range(60))
    rows = [(k, say("##" if k < bad else ""), "en" if k % 2 else None, 1, "x") for k in range(n)]
    rows += [(10_000 + k, rows[bad][1], "en", 1, "x") for k in range(500)]  # copies of one good text count once
    rows += [(20_000, say("##"), "rare", 1, "x")]
    labels = [(r[0], int(r[0] >= bad)) for r in rows if r[0] < 20_000] + [(5, None), (None, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), bad


def test_cutoffs_are_those_of_the_method(spark):
    docs, labels, bad = labelled(spark)
    rows = qr.measured(docs)
    cuts = {r.stratum: r.cut_step for r in qr.cutoffs(rows, labels).collect()}
    # by hand: every step's verdict over the trials of a stratum
    values = {r.doc_id: {n: float(v) for n, v in zip(qr.RULES, (r.n_symbols / max(1, r.n_words), r.n_dup_lines / max(1, r.n_lines), r.n_repeat_words / max(1, r.n_words), r.word_chars / max(1, r.n_words), -r.word_chars / max(1, r.n_words)))} for r in rows.collect()}
    seen = {r.doc_id: r for r in docs.collect()}
    want = {}
    for stratum, lang in (("en", "en"), ("\x00", None)):
        trials = {}
        for d, r in seen.items():
            if d < 20_000 and r.lang == lang:
                trials.setdefault(r.text, (int(d >= bad), values[d]))
        good, rotten = ([v for g, v in trials.values() if g == q] for q in (1, 0))
        best = None
        for g, step in enumerate(qr.STEPS):
            hit = lambda v: any(v[r] > step[r] for r in step)
            k, b = sum(map(hit, good)), sum(map(hit, rotten))
            if tail(k, len(good), qr.RISK) > qr.ERROR / 2:
                break
            gain = b / len(rotten) - k / len(good)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, g
        want[stratum] = best[1]
    assert cuts == want and set(cuts) == {"en", "\x00"}
    kept = {r.doc_id for r in qr.kept(docs, labels).collect()}
    judged = {r.doc_id for r in qr.judged(rows, qr.cutoffs(rows, labels)).where("kept").collect()}
    assert kept == judged and not kept & set(range(bad)) and set(range(bad, 700)) <= kept
    assert 20_000 in kept  # a stratum without labels isn't judged by the learned rules


def test_rows_stay_as_they_are(spark):
    docs, labels, _ = labelled(spark, 300, 0)
    out = qr.kept(docs, labels)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    none = docs.where("false")
    assert qr.kept(none, labels).count() == 0 and qr.kept(docs, labels.where("false")).count() == docs.count()
    assert qr.cutoffs(qr.measured(none), labels).count() == 0


def test_no_python_and_one_measuring(spark):
    docs, labels, _ = labelled(spark, 100, 0)
    plan = qr.kept(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("xxhash64") == 1
