"""Session helpers: the shared folder, written intermediate tables, joins that survive hot keys, the tables of a data folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``. Only in local mode, where one machine is all there is, an unset one is set here."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexiloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it survives lost executors and cuts the lineage.

    Results read these files, so they stay until ``cleared``.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


_SCRATCH: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way are deleted."""
    _SCRATCH.append([])
    try:
        out = make()
    finally:
        used = _SCRATCH.pop()
    kept = written(out, name)
    for path in used:
        _deleted(spark, path)
    return kept


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that nothing reads any more."""
    if path := getattr(df, "_written_to", None):
        _deleted(df.sparkSession, path)


def cleared(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; to be called when its results are written."""
    _deleted(spark, _own_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting on both sides: never broadcast for an estimated size, which the driver may fail to hold."""
    return df.hint("merge")


def joined(rows: DataFrame, stats: DataFrame, on: Sequence[str], weight: str, share: int = 500) -> DataFrame:
    """``rows`` left-joined with ``stats``, which has one row a key and in ``weight`` how many of ``rows`` have it.

    Keys with at least a ``share``-th of the whole weight are at most ``share``; those are broadcast, so no hot key
    meets in one task. The others are shuffled.
    """
    total = stats.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in stats.columns if c not in (*on, weight)]
    hot = stats.where(F.col(weight) * share >= F.lit(total)).select(*on, *rest) if total else stats.select(*on, *rest).limit(0)
    cold = stats.where(F.col(weight) * share < F.lit(total)).select(*on, *rest)
    first = rows.join(F.broadcast(hot), list(on))
    second = rows.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(spread(cold), list(on), "left")
    return first.unionByName(second)
