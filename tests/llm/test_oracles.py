from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from lexiloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


WANT = {
    "op1": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "doc_id n_shingles component_id kept",
    "op4": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6": "doc_id held_out score predicted", "op7": "page_id host path rule verdict",
    "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "conv_id part turn role segment loss", "op10": "doc_id size source_size target taken",
}
LONG = {"n_email", "n_words", "n_repeat_words", "n_shingles", "n_hit", "n_items", "n_tokens", "n_known", "train_tokens", "size", "text_crc32", "slot", "taken", "source_size"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_keeps_its_contract_and_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(WANT[name.split("_")[0]].split()) <= set(df.columns)
    assert all(kind == "bigint" for c, kind in df.dtypes if c in LONG)
    if name not in queries.ORACLE_SQL:
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in place]) for r in want.fetchall())
