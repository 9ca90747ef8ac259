"""Sharding by jump consistent hashing (operator 8).

A key's shard follows from its 64-bit hash and the number of shards alone: no ring table, and appending a shard moves
only about 1/(n+1) of the keys, all into the new one. Law ``key``: documents with one doc_id share a shard.

The slot is a gapless number in the shard. It needs no sort of a whole shard: keys fall into hash buckets, buckets are
numbered by prefix sums of their counts, and only a bucket's distinct rows are sorted, with their counts. Equal rows are
numbered in up to ``SPREAD`` parts, by the files that they are in.

Null texts have no bytes; a null doc_id is a key of its own. Rows with equal keys stay together, each with its own slot;
among equal rows slots are in any order. A very long text is a row like others. Extra columns are ignored, or stay where
rows are returned whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import table, written

SHARDS = 24
#: Rows that a slot bucket should hold.
BUCKET_ROWS = 200_000
#: Parts into which equal rows are spread.
SPREAD = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys."""
    key = keys.astype(np.uint64)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.float64)
    left = np.arange(len(key))
    while len(left):
        at[left] = ahead[left].astype(np.int64)
        key[left] = key[left] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[left] = (at[left] + 1) * (float(1 << 31) / ((key[left] >> np.uint64(33)).astype(np.float64) + 1))
        left = left[ahead[left] < shards]
    return at


def hashed(key: Column) -> Column:
    """60 bits of the MD5 of a key as text; a null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _assign(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = np.asarray(batch.column(batch.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)).view(np.uint64)
        new = [pa.array(jump(key, n), pa.int32()) for n in (shards, shards + 1)]
        rest = batch.select([c for c in batch.schema.names if c != "_key"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *new], [*rest.schema.names, "shard", "grown_shard"])


def _placed(docs: DataFrame, shards: int, text: str, key: str, *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32, ``more``, shard, grown_shard, slot) of every row."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), *more,
        hashed(F.col(key)).alias("_key"), F.pmod(F.xxhash64(F.input_file_name()), F.lit(SPREAD)).cast("int").alias("_spread"),
    )
    schema = StructType([*(f for f in rows.schema.fields if f.name != "_key"), StructField("shard", IntegerType()), StructField("grown_shard", IntegerType())])
    rows = rows.mapInArrow(lambda it: _assign(it, shards), schema)
    own = ["doc_id", "text_crc32", "size", "_spread"]
    rows = rows.withColumn("_own", F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in own]))
    buckets = 1 + docs.select(key).count() // (shards * BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).alias("_bucket")
    counts = written(rows.groupBy("shard", *own, "_own", bucket).agg(F.count("*").alias("_n")), "counts")
    # at most shards * buckets rows: one for every BUCKET_ROWS documents or so
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_sum")).select("shard", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, ["shard", "_bucket"])
    starts = starts.select("_own", (F.col("_before") + F.col("_inside")).alias("_start"))
    # the rows' only shuffle, for both the numbers within equal rows and the join
    at = F.row_number().over(Window.partitionBy("_own").orderBy("_spread"))
    return rows.withColumn("_at", at).join(starts, "_own").withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    return _placed(docs, shards, text, key).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, own columns and (shard, slot), in place of columns of these names; slots are those of ``sharded``."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return _placed(docs, shards, text, key, F.struct(*own).alias("_row")).select("_row.*", "shard", "slot")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
