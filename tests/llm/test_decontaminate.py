from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from lexiloom.llm import decontaminate as dc
from lexiloom.llm.fm_index import FmIndex


def tables():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["the", "Cat", "sat", "on", "a", "mat", "élan", "x1"]) + rng.choice(["", ",", "!", "\n"]) for _ in range(n))
    items = [(str(k), say(rng.choice([0, 3, 9, 10, 11, 40]))) for k in range(30)] + [(None, "only words of ten or fewer"), ("3", say(30)), ("n", None), ("u", "one two three four five six seven eight nine ten eleven")]
    docs = [(k, say(rng.randrange(80))) for k in range(60)]
    docs += [(100, "so, " + items[33][1].upper() + " and on"), (101, None), (102, ""), (103, "!!!"), (104, "eight nine ten eleven one two three"), (104, "eight nine ten eleven one two three"), (105, (say(50) + " ") * 60), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("size", [4 << 20, 100])
def test_report_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(dc, "PASS_BYTES", size)
    docs, items = tables()
    got = dc.contamination(spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, _ranges int, `a.b` string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(brute.decontaminate(docs, items), key=repr)
    by = {r.doc_id: r for r in got}
    (span,) = by[100].spans
    assert docs[60][1][span.start : span.end] == items[33][1].upper()


@pytest.mark.parametrize("size", [4 << 20, 100])
def test_cut_texts(spark, monkeypatch, size):
    monkeypatch.setattr(dc, "PASS_BYTES", size)
    items = [("u", "one two three four five six seven eight nine ten eleven"), ("s", "short item")]
    docs = [(1, "Before. ONE two three, four five six seven eight nine ten!  After", 7, "x"), (2, "a short item, a short Item", 8, "y"), (3, "clean é", 9, "z"), (4, None, None, None)]
    got = dc.decontaminated(spark.createDataFrame(docs, "doc_id long, text string, _items int, `a.b` string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got.columns == ["doc_id", "text", "_items", "a.b"]
    assert sorted(map(tuple, got.collect())) == [(1, "Before. !  After", 7, "x"), (2, "a , a ", 8, "y"), (3, "clean é", 9, "z"), (4, None, None, None)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert tuple(dc.contamination(docs, items).first())[:4] == (1, 2, 0, 0)
    assert dc.contamination(docs.where("false"), items).count() == 0 and dc.decontaminated(docs, items).first().text == "a b"


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(1, 4, 300)
    index = FmIndex(seq, 5)
    patterns = np.array([seq[k : k + 4] for k in range(0, 280, 7)] + [[4, 4, 4, 4]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(297) if (seq[k : k + 4] == p).all()]
