"""Quality classifier: Naive Bayes support vectors (operator 6).

A text's indicators are its distinct byte trigrams, words and word pairs (A-Z as a-z in words), and for neighbouring
words whether they're equal; hashed to ``2 ** FEATURE_BITS``. Each is scaled by its log-count ratio between the classes,
``r = log(p / |p|) - log(q / |q|)`` with ``SMOOTH`` added to each count, and a text's vector has length 1. On these a linear hinge-loss
model is fitted by dual coordinate descent, its weights drawn to their mean by 1 - ``BETA`` as usual for this model.
A logistic curve over the margins of a fifth of the sample, kept out of the fit, gives the score.

The fit is in one task over a bounded sample: of the labelled training rows the ``TRAIN_ROWS`` with the smallest hash of
their doc_id, of those as many as have ``TRAIN_FEATURES`` indicators in sum. Every row is scored, by its whole text.

Null and empty texts have no indicators; their score follows from the bias. A null doc_id isn't held out and has no label.
Null labels don't count; of several labels of a doc_id the worst counts, of several rows of a doc_id each counts.
Without labels the score is 0.5, with one class alone its smoothed share. Very long texts are read in pieces, all of
them. Equal texts get equal scores. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written
from .textblock import SPACE, U64, blocks, column, distinct, mix, word_hashes, words

FEATURE_BITS = 18
TRAIN_ROWS, TRAIN_FEATURES = 16_384, 24_000_000
SMOOTH, COST, EPOCHS, BETA, FOLDS = 1.0, 1.0, 12, 0.5, 5
#: From this score on, a text is predicted to be good.
GOOD = 0.3
_MASK = U64((1 << FEATURE_BITS) - 1)
_PIECE = 1 << 21


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators of every document, sorted, and each document's first one (length: documents + 1)."""
    n, docs = len(data), len(off) - 1
    kind = np.uint32 if docs <= 1 << (32 - FEATURE_BITS) else np.uint64  # sorting half the width takes half the time
    owner = np.repeat(np.arange(docs, dtype=kind) << kind(FEATURE_BITS), np.diff(off))
    keys = [np.zeros(0, kind)]
    for lo in range(0, n - 2, _PIECE):
        hi = min(n - 2, lo + _PIECE)
        x = data[lo : hi + 2].astype(U64)
        three = mix((x[:-2] << U64(16)) | (x[1:-1] << U64(8)) | x[2:])
        inside = owner[lo:hi] == owner[lo + 2 : hi + 2]
        keys.append(distinct((owner[lo:hi] | (three & _MASK).astype(kind))[inside]))
    start, end, first = words(data, off, SPACE)
    if len(start):
        h, own = word_hashes(data, start, end), np.repeat(np.arange(docs, dtype=kind) << kind(FEATURE_BITS), np.diff(first))
        pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
        pair = np.where(h[:-1] == h[1:], U64(0x5BD1E995), pair)
        inside = own[:-1] == own[1:]
        keys.append(own | (h & _MASK).astype(kind))
        keys.append((own[:-1] | (pair & _MASK).astype(kind))[inside])
    every = distinct(np.concatenate(keys))
    return (every & kind(_MASK)).astype(np.int64), np.searchsorted(every, np.arange(docs + 1, dtype=np.uint64) << U64(FEATURE_BITS))


def _indicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, doc_id, good, ids) of rows (at, doc_id, good, text)."""
    for batch in batches:
        for lo, hi, data, off in blocks(column(batch, "text")):
            ids, first = indicators(data, off)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), lists], ["at", "doc_id", "good", "ids"])


def log_ratios(ids: list[np.ndarray], good: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log-count ratios of all indicators, 0 for those that no text has."""
    size = 1 << FEATURE_BITS
    p, q = (np.bincount(np.concatenate([x for x, g in zip(ids, good, strict=True) if g == c] or [np.zeros(0, np.int64)]), minlength=size) for c in (1, 0))
    seen = (p + q) > 0
    p, q = p + smooth, q + smooth
    return np.where(seen, np.log(p / p[seen].sum()) - np.log(q / q[seen].sum()), 0.0)


def hinge_fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM, by dual coordinate descent over the rows in random orders."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton's method with smoothed targets."""
    n1, n0 = (good == 1).sum(), (good == 0).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return (a, b) if a > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit(ids: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled weights, squared log-count ratios, and (bias, a, b)."""
    size = 1 << FEATURE_BITS
    none = np.zeros(size, np.float32)
    n1, n0 = int((good == 1).sum()), int((good == 0).sum())
    prior = np.array([0.0, 0.0, np.log((n1 + 1) / (n0 + 1))])
    held = np.arange(len(ids)) % FOLDS == 0
    if min((good[~held] == 1).sum(), (good[~held] == 0).sum()) == 0:
        return none, none, prior
    train = np.flatnonzero(~held)
    r = log_ratios([ids[i] for i in train], good[train])
    unit = lambda x: r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum()))
    w, bias = hinge_fit([ids[i] for i in train], [unit(ids[i]) for i in train], np.where(good[train] == 1, 1.0, -1.0), size)
    w = BETA * w + (1 - BETA) * np.abs(w).sum() / max(1, (r != 0).sum())
    weights, squares = (w * r).astype(np.float32), (r * r).astype(np.float32)
    margins = np.array([weights[ids[i]].sum() / max(1e-9, np.sqrt(squares[ids[i]].sum())) + bias for i in np.flatnonzero(held)])
    a, b = logistic_curve(margins, good[held])
    return weights, squares, np.array([bias, a, b])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, good, total = [], [], 0
    for batch in batches:
        lists, of = batch.column(3), batch.column(2).to_pylist()
        first = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        for k, g in enumerate(of):
            total += first[k + 1] - first[k]
            if total <= TRAIN_FEATURES:
                ids.append(flat[first[k] : first[k + 1]].copy())
                good.append(g)
    model = fit(ids, np.array(good, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in model], ["weights", "squares", "curve"])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights, squares, curve = (np.frombuffer(x, t) for x, t in zip(model.value, (np.float32, np.float32, np.float64), strict=True))
    for batch in batches:
        for lo, hi, data, off in blocks(column(batch, "text")):
            ids, first = indicators(data, off)
            sums = [np.concatenate([[0.0], np.cumsum(v[ids], dtype=np.float64)]) for v in (weights, squares)]
            top, below = (s[first[1:]] - s[first[:-1]] for s in sums)
            margin = np.where(below > 1e-12, top / np.sqrt(np.maximum(below, 1e-12)), 0.0) + curve[0]
            score = 1 / (1 + np.exp(-np.clip(curve[1] * margin + curve[2], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.round(score, 9))], ["doc_id", "held_out", "score"])


def trained(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[bytes, bytes, bytes]:
    """The model from ``labels`` (doc_id, good) of the rows of docs (doc_id, text) that aren't held out."""
    known = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").cast("long").alias("good")).where(~held_out)
    known = known.select(F.xxhash64("doc_id").alias("at"), "doc_id", "good").orderBy("at", "doc_id").limit(TRAIN_ROWS)
    rows = docs.join(F.broadcast(known), "doc_id").select("at", "doc_id", "good", "text")  # at most TRAIN_ROWS ids
    sample = rows.mapInArrow(_indicated, "at long, doc_id long, good long, ids array<int>").orderBy("at", "doc_id", F.xxhash64("ids")).limit(TRAIN_ROWS)
    model = written(sample.coalesce(1).mapInArrow(_fitted, "weights binary, squares binary, curve binary"), "classifier")
    return tuple(bytes(x) for x in model.first())


def classified(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. ``held_out``: by doc_id, rows whose labels aren't learned from."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    model = trained(rows, labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("good")), out)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 4 * 2 ** FEATURE_BITS bytes
    scored = rows.select("doc_id", out.alias("held_out"), "text").mapInArrow(lambda it: _scored(it, sent), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
