from __future__ import annotations

import corpus_pipeline
from lexiloom.llm import sharding


def test_last_stage_keeps_the_documents(spark, monkeypatch):
    rows = [(k % 30, f"text {k}" if k % 7 else None, "en", "web", k) for k in range(60)] + [(None, "", None, None, None)] + [(1, "same", "de", "web", 4)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    places = []
    for most in (200_000, 1):  # one bucket, and several
        monkeypatch.setattr(sharding, "BUCKET_ROWS", most)
        out = corpus_pipeline.shard(spark, docs, "").collect()
        assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(rows, key=repr)
        by = {}
        for r in out:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        places.append(sorted((r.doc_id or -1, r.shard) for r in out))
        digest = sharding.sharded(docs).collect()
        assert sorted((r.doc_id or -1, r.shard, r.slot) for r in digest) == sorted((r.doc_id or -1, r.shard, r.slot) for r in out)
    assert places[0] == places[1]
