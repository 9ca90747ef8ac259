"""Tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's files, read as a stream."""
    where = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(where).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(where)
