from __future__ import annotations

import hashlib
import random

import brute
import pytest
from lexiloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def rows():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    out = [(k, say(rng.randrange(40)), "big" if k < 60 else rng.choice(["a", "b", "é", "Z", None]), 1, "x") for k in range(150)]
    return out + [(200, None, "a", None, None), (None, "", "b", 0, ""), (201, "one", "tiny", 3, ""), (5, out[5][1], "big", 1, "x"), (5, out[5][1], "big", 1, "x"), (202, "w " * 3000, "b", 1, "")]


def brute_mix(data):
    sizes = [len(brute.spaced(t)) for _, t, *_ in data]
    names = sorted({r[2] for r in data}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(sizes, data) if r[2] == s) for s in names}
    left, open_, target = 1.5 * sum(sizes), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    taken = [0] * len(data)
    for s in names:
        budget = int(target[s] + 1e-6)
        own = [k for k, r in enumerate(data) if r[2] == s]
        key = lambda k: hashlib.md5("\x1f".join(["0", "\x1e" if data[k][0] is None else str(data[k][0]), "\x1e" if data[k][1] is None else data[k][1]]).encode()).hexdigest()[:12]
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for k in sorted(own, key=key):
            part = min(sizes[k], rest)
            rest -= part
            taken[k] = epochs * sizes[k] + part
    return [(r[0], n, total[r[2]], round(target[r[2]], 6), t) for r, n, t in zip(data, sizes, taken)]


@pytest.mark.parametrize("most", [50_000, 7])
def test_mix_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "RANGE_ROWS", most)
    data = rows()
    got = mixing.mixed(spark.createDataFrame(data, SCHEMA)).collect()
    key = lambda r: repr((r[0] is None, r[0] or 0, *r[1:]))
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(brute_mix(data), key=key)


def test_documents_have_their_words(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.spaced(r.text))
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    want = {}
    for d, _, _, _, taken in brute_mix(data):
        want[d] = want.get(d, 0) + taken
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in want.items() if n}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert mixing.mixed(blank).first().taken == 0
