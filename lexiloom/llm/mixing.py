"""Mixing sources to target weights (operator 10), with DataFrame operations only.

Every row has a hash-random key: a uniform number from MD5 of seed, doc_id and text. Within a source, rows stand in the
order of their keys. The prefix sum of sizes is distributed: keys fall into equal ranges, the sums of the ranges are
added up in a small table, and only a range is sorted in a task; so a source that holds a third of all rows is spread.
A source's budget takes whole epochs and then the rows up to the exact remainder, the last one in part.

Null texts and texts without words have size 0 and give no words; their rows come with every whole epoch. A null source is
a source, the last one. Equal rows have equal keys and stand in any order: ties take the same words in sum. A very long
text is a row like others. Extra columns are ignored, or stay where rows are returned; no rows give no rows. Sources are
counted in one small table, a row each, which one task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows that a key range of a source should hold.
RANGE_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Maximal runs of other characters than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\x0b\x0c\r]+")), F.lit(0))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size): shares by weight, filled up to ``most`` times the size.

    Resharing the excess until nothing is above its cap ends at target = min(cap, level * weight), where the level
    spends the total. Sources stand by cap / weight; the first level under the next one's ratio is the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # UTF-8 order is code point order
    by = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    ranked = sources.withColumn("w", by).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy("ratio", F.col("source").isNull(), "source")
    sums = (
        ranked.withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    return sums.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def random_key(seed: int, *parts: Column) -> Column:
    """A uniform whole number under 2**48, the same in every run."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def _plan(rows: DataFrame, again: DataFrame, weights, share: float, most: int) -> DataFrame:
    """``rows`` (source, size, _key, ...) with source_size, target, epochs and part; ``again``: the same rows, read for sums."""
    counts = written(again.groupBy("source").agg(F.count("*").alias("_rows"), F.sum("size").alias("source_size")), "sources")
    plan = targets(counts.select("source", "source_size"), weights, share, most).join(counts.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = written(plan.withColumn("_ranges", (1 + F.col("_rows") / RANGE_ROWS).cast("long")).withColumnRenamed("source", "_s"), "targets")
    here = F.col("source").eqNullSafe(F.col("_s"))
    spot = F.floor(F.col("_key").cast("double") * F.col("_ranges") / F.lit(float(1 << 48))).cast("long")
    sums = again.join(plan, here).groupBy("_s", spot.alias("_r")).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_s").alias("_t"), "_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_s", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(plan, here).withColumn("_range", spot).withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_r")))
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    return placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_at"))).cast("long"))


def _sized(docs: DataFrame, seed: int, text: str, key: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).cast("long").alias("size"), random_key(seed, F.col(key), F.col(text)).alias("_key"), *more)


def mixed(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: int = MOST, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, epochs) of every row; ``epochs``: whole copies taken."""
    rows = written(_sized(docs, seed, text, key, source), "sized")
    out = _plan(rows, rows, weights, share, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "source", "epochs")


def mixed_documents(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: int = MOST, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, own columns only, once per copy taken; a last copy has its first ``part`` words."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = _plan(_sized(docs, seed, text, key, source, whole), written(_sized(docs, seed, text, key, source), "sized"), weights, share, most)
    copies = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    copies = F.when((F.col("part") > 0) & (F.col("size") > 0), F.array_append(copies, F.col("part"))).otherwise(copies)
    out = out.select("_row", "size", F.explode(copies).alias("_take"))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(f"_row.{text}"), "[ \t\n\x0b\x0c\r]+"), lambda w: w != ""), 1, F.greatest(F.lit(1), F.col("_take").cast("int"))), " ")
    taken = F.when(F.col("_take") < F.col("size"), cut).otherwise(F.col(f"_row.{text}"))
    out = out.select(*[taken.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
