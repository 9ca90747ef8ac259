"""A training corpus in five stages; each takes (spark, docs, sf_dir), and its result is written and read as the next one's docs.

All stages return the columns of ``documents``, the last one also shard and slot. Quality rules drop the documents they reject; near-duplicate
detection keeps one document of each component; decontamination cuts benchmark passages out of texts; mixing keeps what
each source's budget takes, with whole copies and a cut last text; sharding adds each row's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, mixing, near_duplicates, quality_rules, sharding
from lexiloom.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per component: of rows with the kept doc_id the first by content."""
    return near_duplicates.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

#: SQL can follow single stages (see lexiloom/llm/sql.py), not texts cut at spans and mixed words; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
