from __future__ import annotations

import random

import numpy as np
import pytest
from lexiloom.llm import quality_classifier as qc
from lexiloom.llm.textblock import U64, mix
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, score double, `a.b` string"


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ne") for b in ("ka", "lo", "si", "pu", "ve")]
    rows = []
    for k in range(n):
        good = k % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good or rng.random() < 0.5 else "$$") for _ in range(rng.randrange(5, 60)))
        rows.append((k, text, good))
    return rows


def held(df=None):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    odd = [(1000, None), (1001, ""), (1002, " "), (None, "takalo"), (1003, "x"), (1004, "takalo $$ " * 40_000), (7, rows[7][1])]
    docs = spark.createDataFrame([(k, t, 0.5, "q") for k, t, _ in rows] + [(k, t, 0.5, "q") for k, t in odd], SCHEMA)
    labels = spark.createDataFrame([(k, int(g)) for k, _, g in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = qc.classified(docs, labels, held()).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.held_out))
    assert all(len(v) == 1 for v in by.values())  # repeated rows are scored alike
    truth = {k: g for k, _, g in rows}
    away = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(away) > 40 and sum(r.predicted == truth[r.doc_id] for r in away) / len(away) > 0.95
    assert {1000, 1001} <= set(by) and by[1000] == {(s, h) for s, h in by[1000]}
    # held-out labels have no influence
    other = labels.withColumn("quality", F.when(held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in qc.classified(docs, other, held()).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(k, 1) for k in range(8)], 9 / 10)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(k, t, 0.5, "q") for k, t, _ in corpus(10)], SCHEMA)
    got = qc.classified(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {round(r.score, 6) for r in got} == {score}
    assert qc.classified(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def naive_indicators(text):
    data = text.encode()
    mask = U64((1 << qc.FEATURE_BITS) - 1)
    return {int(mix(np.array([data[k] << 16 | data[k + 1] << 8 | data[k + 2]], U64))[0] & mask) for k in range(len(data) - 2)}


@pytest.mark.parametrize("piece", [1 << 21, 50])
def test_indicators(monkeypatch, piece):
    monkeypatch.setattr(qc, "_PIECE", piece)
    texts = ["abcabc abd", "", "zz", "é" * 90, "x y x y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, first = qc.indicators(data, off)
    for k, t in enumerate(texts):
        own = ids[first[k] : first[k + 1]]
        assert len(np.unique(own)) == len(own) and naive_indicators(t) <= set(own.tolist())
        words = t.split()
        assert len(own) <= len(naive_indicators(t)) + len(set(words)) + len(set(zip(words, words[1:])))


def test_hinge_fit_reaches_the_optimum():
    """The dual's solution against subgradient steps on the same problem."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ rng.normal(size=5) + rng.normal(size=60) * 0.5 > 0, 1.0, -1.0)
    rows, values = [np.arange(5)] * 60, list(x)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    w, b = qc.hinge_fit(rows, values, y, 5, epochs=300)
    v, c, best = np.zeros(5), 0.0, np.inf
    for t in range(20_000):
        hit = y * (x @ v + c) < 1
        v, c = v - (v - (y[hit, None] * x[hit]).sum(0)) / (t + 20), c - (c - y[hit].sum()) / (t + 20)
        best = min(best, loss(v, c))
    assert loss(w, b) <= best * 1.001
