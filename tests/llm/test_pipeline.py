from __future__ import annotations

import random
import re

import brute
import corpus_pipeline
from test_mixing import brute_mix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables():
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(500)}" for _ in range(n))
    items = [(k, say(14)) for k in range(4)]
    docs = [(k, say(rng.randrange(50, 120)), "en", rng.choice(["x", "y", "z"])) for k in range(50)]
    docs += [(100 + k, docs[k][1], "en", "x") for k in range(5)]  # exact copies
    docs += [(200 + k, docs[k + 10][1] + " tail", "en", "y") for k in range(5)]  # near copies
    docs += [(300 + k, say(60) + " " + items[k][1].upper() + ", " + say(30), "en", "z") for k in range(4)]  # passages of the benchmark
    docs += [(400, say(49), "en", "x"), (401, "a b c " * 40, "en", "x"), (402, None, None, None), (403, "", "en", "x")]
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs], items


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def brute_shard(doc_id) -> int:
    import hashlib

    return jump(int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:15], 16), 24)


def cut(text: str, items) -> str:
    """The text without the words, and what is between neighbours, of all windows of items."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(text)))
    windows = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(t))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    hit = set()
    for w in windows:
        for k in range(len(words) - len(w) + 1):
            if tuple(m.group() for m in words[k : k + len(w)]) == w:
                hit |= set(range(k, k + len(w)))
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : words[k].start()])
        at = words[k].end() if k + 1 not in hit else at
    return "".join([*out, text[at:]])


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = got.collect()

    left = [d for d in docs if not brute.quality(d[1])[5]]  # too few labels for learned cutoffs
    root = brute.components([(d[0], d[1]) for d in left])
    left = [d for d in left if root[d[0]][1] == d[0]]
    left = [(d[0], t := cut(d[1], items), d[2], d[3], len(t)) for d in left]
    want = []
    for d, (_, size, _, _, taken) in zip(left, brute_mix([(d[0], d[1], d[3], d[4], "") for d in left])):
        for n in [size] * (taken // size) + [taken % size] * (taken % size > 0):
            text = d[1] if n == size else " ".join(WORD.findall(d[1])[:n])
            want.append((d[0], text, d[2], d[3], len(text), brute_shard(d[0])))
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert not {r.doc_id for r in rows} & {400, 401, 402, 403, *range(100, 105), *range(200, 205)}


def test_stages_take_empty_tables_and_odd_columns(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame([(*d, 1, "q", 2) for d in docs[:60]] + [(None, None, None, None, None, None, None, None)], COLUMNS + ", _row int, `a.b` string, n int")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        assert set(odd.columns) <= set(out.columns)
        out.write.format("noop").mode("overwrite").save()
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
