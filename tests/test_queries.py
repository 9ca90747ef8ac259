from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from lexiloom import queries

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[k] for k in place) for r in want.fetchall())))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).limit(5).count() == 5


def test_byte_level_pieces_restore_their_texts(spark):
    from lexiloom.functions.codemap import BYTE_MAP, CodeMap
    from pyspark.sql import functions as F

    pieces = queries.byte_level_pieces(spark, FOLDER).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    back = pieces.select("doc_id", CodeMap(*BYTE_MAP).inverse()(F.array_join(F.transform("p", lambda p: p["x"]), "")).alias("t"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(back, "doc_id", "left")
    assert docs.where("not (text <=> t) and text <> ''").count() == 0


def test_flagship_plan(spark):
    plan = queries.flagship(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_entry_and_bench():
    env = os.environ | {"BENCH_SF_DIR": FOLDER, "BENCH_CPUS": "2", "BENCH_QUERIES": "split_words,encode_fixed", "PYTHONPATH": str(ROOT)}
    out = subprocess.run([sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True, timeout=300, cwd=ROOT)
    said = json.loads(out.stdout.strip().splitlines()[-1])
    assert set(said["queries"]) == {"split_words", "encode_fixed"} and said["sf"] == 0.001 and said["value"] > 0
