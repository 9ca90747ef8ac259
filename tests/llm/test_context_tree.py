from __future__ import annotations

import math
import random
from collections import Counter

import brute
import pytest
from lexiloom.llm import context_tree as ct
from pyspark.sql import functions as F


def bits(symbol):
    return [((1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1) for j in range(8)]


def symbols(text):
    return list(brute.ascii_lower(text or "").encode()) + [ct.END]


def contexts(seq, depth):
    past = [ct.END] * depth
    for s in seq:
        yield tuple(past[::-1]), s
        past = [*past[1:], s]


def brute_scores(train, every, depth):
    """log10 probabilities by the recursive definition of context-tree weighting."""
    counts = Counter()
    for text in train:
        for past, s in contexts(symbols(text), depth):
            for node, bit in bits(s):
                for d in range(depth + 1):
                    counts[node, past[:d], bit] += 1
    nodes = {(n, c) for n, c, _ in counts}
    children = {}
    for n, c in nodes:
        if c:
            children.setdefault((n, c[:-1]), []).append(c)
    half, log_p = math.log(0.5), {}

    def weighted(n, c):
        if (n, c) not in log_p:
            a, b = counts[n, c, 0], counts[n, c, 1]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(c) == depth:
                log_p[n, c] = own, own, 1.0
            else:
                below = sum(weighted(n, k)[0] for k in children.get((n, c), []))
                top = max(own, below)
                both = half + top + math.log(math.exp(own - top) + math.exp(below - top))
                log_p[n, c] = both, own, math.exp(half + own - both)
        return log_p[n, c]

    def chance(n, past, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            c = past[:d]
            if (n, c) not in nodes:
                continue
            share = weighted(n, c)[2]
            kt = (counts[n, c, bit] + 0.5) / (counts[n, c, 0] + counts[n, c, 1] + 1)
            p = share * kt + (1 - share) * p
        return p

    return [sum(math.log10(chance(n, past, b)) for past, s in contexts(symbols(t), depth) for n, b in bits(s)) for t in every]


def rows(seed=1, n=40):
    rng = random.Random(seed)
    words = ["the", "ER!!", "élan", "ße", "a", "b", "tion", "ing"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(n)]
    texts += ["", None, "x" * 300, "\n", texts[0], texts[0], "😺 ZZ"]
    return [(k if k != 3 else None, t, "extra", 1) for k, t in enumerate(texts)] + [(0, texts[0], "again", 2)]


@pytest.mark.parametrize("block", [2_000_000, 50])
@pytest.mark.parametrize("depth", [3, 4])
def test_scores_follow_the_definition(spark, monkeypatch, block, depth):
    monkeypatch.setattr(ct, "BLOCK", block)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, n_known string, score int")
    got = sorted(ct.scored(docs, F.col("doc_id") % 3 == 1, depth=depth).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.score))
    held = [r[0] is not None and r[0] % 3 == 1 for r in data]
    want = brute_scores([r[1] for r, h in zip(data, held) if not h], [r[1] for r in data], depth)
    c = Counter(w for r, h in zip(data, held) if not h for w in [*brute.spaced(brute.ascii_lower(r[1] or "")), "<end>"])
    n = sum(c.values())
    full = []
    for (doc, text, *_), h, s in zip(data, held, want):
        w = [*brute.spaced(brute.ascii_lower(text or "")), "<end>"]
        full.append((doc, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), s))
    full.sort(key=lambda r: (r[0] is None, r[0], r[6]))
    assert len(got) == len(full)
    for g, f in zip(got, full):
        assert tuple(g)[:5] == f[:5]
        assert g.base_score == pytest.approx(f[5], rel=1e-9) and g.score == pytest.approx(f[6], rel=1e-9)
        assert g.bits_per_byte == pytest.approx(-f[6] * math.log2(10) / len(symbols(next(t for d, t, *_ in data if d == g.doc_id))), rel=1e-9) or g.doc_id is None


def test_estimates_equal_their_definition():
    import numpy as np

    p = np.random.default_rng(0).integers(0, 50, (2, 200)).astype(float)
    assert np.allclose(ct.estimate(*p), [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for a, b in p.T])


def test_empty_tables_and_no_training_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ct.scored(docs).count() == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ct.scored(one, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(24 * math.log10(0.5))


def test_passes_do_not_grow_with_distinct_words(spark, monkeypatch):
    words = ["".join("ab"[n >> j & 1] for j in range(11)) for n in range(2048)]
    texts = [" ".join(words[k::8] * (1 + k % 2)) for k in range(8)] + [" ".join([*words[:40], "b a", "a"])] * 2 + [None]
    names = []
    monkeypatch.setattr(ct, "BLOCK", 600)  # fewer than the words; all strings fit
    monkeypatch.setattr(ct, "written", lambda df, name, own=ct.written: (names.append(name), own(df, name))[1])
    docs = spark.createDataFrame([(min(k, 8), t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = ct.scored(docs, F.col("doc_id").isin(3, 8)).select("doc_id", "n_tokens", "n_known", "base_score").collect()
    assert names.count("pass") == 1
    tokens = [(min(k, 8), [*(t or "").split(), "<end>"]) for k, t in enumerate(texts)]
    c = Counter(w for d, ws in tokens if d not in (3, 8) for w in ws)
    n = sum(c.values()) + len(c) + 1
    want = sorted((d, len(ws), sum(w in c for w in ws), sum(math.log10((c[w] + 1) / n) for w in ws)) for d, ws in tokens)
    for g, w in zip(sorted(map(tuple, got)), want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9)
