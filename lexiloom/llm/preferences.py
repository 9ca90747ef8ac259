"""Preference formatting of chosen and rejected conversations (operator 9), with DataFrame operations only.

A pair is two conversations under one key. Their longest common turn prefix ends before the first turn at which they
differ (in role or text, or as one lacks it). It is rendered once, as the prompt, whose segments never count for the
loss; what follows is rendered on either side, as completions of which only the assistant's turns count.

The result has a row for each rendered turn, so a pair of any length is spread over tasks: ``part`` is prompt, chosen or
rejected, and a part's text is its segments in the order of ``turn``. ``examples`` joins them to one row a pair.
Turns are compared by their count and the sums of two 62-bit hashes, which needs no list of them.

A null turn stands after all others. Rows under one turn number are one turn, whatever their order; among them, segments
stand by role and text. A null text is empty, a null role is 'user'. A null key is a key. Markers in texts are escaped.
A side without turns, or equal sides, give empty completions: no rows of that part. Repeated rows are rendered as often.
Very long texts are a row like others. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import joined, table, written

_LAST = (1 << 63) - 1


def rendered(role: Column, text: Column) -> Column:
    """A turn with its markers; ``<|`` in the text becomes ``<||``, which no marker begins with."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("<||")), F.lit("<|end|>\n"))


def _turns(rows: DataFrame, key: str) -> DataFrame:
    """(pair, turn, role, text), all but the pair's key not null; ``pair`` is a struct, so that a null key is a key."""
    return rows.select(
        F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("pair"), F.col(key).alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def _mark(role: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), role, text), 2).cast("decimal(38,0)")


def first_difference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, first, n): the first turn that differs, null if none does, and the turns of both sides; from ``_turns``."""
    marks = lambda t, side: t.select("pair", "turn", F.lit(side).alias("s"), _mark(F.col("role"), F.col("text"), 1).alias("x"), _mark(F.col("role"), F.col("text"), 2).alias("y"))
    both = marks(chosen, 1).unionByName(marks(rejected, -1))
    signed = lambda c: F.sum(F.col("s") * c)
    turns = both.groupBy("pair", "turn").agg(signed(F.lit(1)).alias("c"), signed(F.col("x")).alias("x"), signed(F.col("y")).alias("y"), F.count("*").alias("n"))
    differs = (F.col("c") != 0) | (F.col("x") != 0) | (F.col("y") != 0)
    return turns.groupBy("pair").agg(F.min(F.when(differs, F.col("turn"))).alias("first"), F.sum("n").alias("n"))


def preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, part, turn, role, segment, loss): the rendered turns of all pairs."""
    c, r = _turns(chosen, key), _turns(rejected, key)
    first = written(first_difference(c, r), "differences")
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    c = joined(c, first, ["pair"], "n").withColumn("part", F.when(common, F.lit("prompt")).otherwise(F.lit("chosen")))
    r = joined(r, first, ["pair"], "n").where(~common).withColumn("part", F.lit("rejected"))
    out = c.unionByName(r)
    turn = F.when(F.col("turn") != _LAST, F.col("turn"))
    return out.select(F.col("pair_id").alias(key), "part", turn.alias("turn"), "role", rendered(F.col("role"), F.col("text")).alias("segment"), ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("loss"))


def examples(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and for the completions the [start, end) code points that count.

    A pair becomes one row here, so its turns meet in one task; use the segments where a pair may outgrow one.
    """
    row = F.struct(F.coalesce("turn", F.lit(_LAST)).alias("turn"), "role", "segment", "loss")
    parts = segments.groupBy(key).pivot("part", ["prompt", "chosen", "rejected"]).agg(F.sort_array(F.collect_list(row)))

    def spans(c: str) -> Column:
        size = lambda s: F.length(s["segment"])
        step = lambda acc, s: F.struct((acc["at"] + size(s)).alias("at"), F.when(s["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), (acc["at"] + size(s)).alias("end")))).otherwise(acc["spans"]).alias("spans"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.coalesce(F.aggregate(c, start, step, lambda acc: acc["spans"]), F.array().cast("array<struct<start:int,end:int>>")).alias(f"{c}_loss")

    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["segment"]), ""), F.lit("")).alias(c)
    return parts.select(key, text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


def cut_short(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations whose last reply breaks off after half of its code points: a rejected side for each."""
    pair = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(_LAST))
    last = rows.groupBy(pair.alias("pair")).agg(F.max(F.when(F.col("role") == "assistant", turn)).alias("last"), F.count("*").alias("n"))
    out = joined(rows.select(key, "turn", "role", "text", pair.alias("pair")), written(last, "last"), ["pair"], "n")
    here = (F.col("role") == "assistant") & (turn == F.col("last"))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return out.select(key, "turn", "role", F.when(here, half).otherwise(F.col("text")).alias("text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` has no rejected sides; each conversation's is itself with a last reply that breaks off."""
    rows = table(spark, sf_dir, "conversations")
    return preferences(rows, cut_short(rows))
