"""Vocabularies: tables (idx, word), numbered from 1, with an unknown word.

Lookups are joins: words that a text may hold millions of times meet the vocabulary in a broadcast as long as its row
count, which is known, is at most ``BROADCAST_WORDS``; a larger one is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.plans.nodes import Node

#: A vocabulary of so many rows is broadcast: under 100 MB for words of ordinary lengths.
BROADCAST_WORDS = 1_000_000


def first_seen(words: DataFrame, word: str, order: list[str]) -> DataFrame:
    """(idx, word) of distinct words by their first appearance; ``order``: the numeric column that comes first, and others.

    Words fall into 4096 ranges of the first column, the ranges are numbered by prefix sums, and only a range is sorted.
    """
    place = F.struct(*order)
    seen = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(place).alias("at"))
    lead = F.col(f"at.{order[0]}").cast("double")
    ends = seen.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"))
    ranged = seen.crossJoin(F.broadcast(ends)).withColumn("r", F.floor((lead - F.col("lo")) * 4095 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))).cast("int"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("r").agg(F.count("*").alias("n")).select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # 4096 rows
    own = F.row_number().over(Window.partitionBy("r").orderBy("at", "word"))
    return ranged.withColumn("k", own).join(F.broadcast(counts), "r").select((F.col("base") + F.col("k")).cast("int").alias("idx"), "word")


def most_frequent(words: DataFrame, word: str, k: int) -> DataFrame:
    """(idx, word) of the ``k`` most frequent words, ties by word."""
    top = words.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("idx"), "word")  # k rows


@dataclass(frozen=True, eq=False)
class Vocab(Node):
    """``frame`` (idx, word): words are distinct. ``unk`` is what unknown numbers decode to, whether listed or not."""

    frame: DataFrame
    unk: Any = "[UNK]"

    @classmethod
    def of(cls, spark: SparkSession, words: Iterable[Any], unk: Any = "[UNK]") -> Vocab:
        """From a list; of repeated words the first counts."""
        own = list(dict.fromkeys(words))
        kind = T.LongType() if all(isinstance(w, int) for w in [*own, unk]) else T.StringType()
        schema = T.StructType([T.StructField("idx", T.IntegerType(), False), T.StructField("word", kind, False)])
        return cls(spark.createDataFrame(list(enumerate(own, 1)), schema), unk)

    @classmethod
    def top(cls, words: DataFrame, word: str, k: int, unk: Any = "[UNK]") -> Vocab:
        """The ``k`` most frequent words, ties by word; up to ``BROADCAST_WORDS`` of them are kept on the driver, counted once."""
        frame = most_frequent(words, word, k)
        if k > BROADCAST_WORDS:
            return cls(frame, unk)
        return cls.of(words.sparkSession, [r.word for r in frame.orderBy("idx").collect()], unk)

    @cached_property
    def size(self) -> int:
        return self.frame.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]

    def __len__(self) -> int:
        return self.size

    @cached_property
    def unki(self) -> int:
        """The number of the unknown word; 0 if it isn't listed."""
        row = self.frame.where(F.col("word") == F.lit(self.unk)).first()
        return row.idx if row else 0

    @property
    def eltype(self) -> T.DataType:
        return self.frame.schema["word"].dataType

    def _table(self) -> DataFrame:
        return F.broadcast(self.frame) if self.size <= BROADCAST_WORDS else self.frame

    def encode_ids(self, df: DataFrame, column: str, into: str = "idx", kind: str = "int") -> DataFrame:
        """word -> number, ``unki`` for unknown ones, null for null."""
        own = self._table().select(F.col("word").alias("_word"), F.col("idx").alias("_idx"))
        if isinstance(df.schema[column].dataType, T.StringType) != isinstance(self.eltype, T.StringType):
            raise TypeError(f"{column} isn't of the vocabulary's type {self.eltype.simpleString()}")
        out = df.join(own, F.col(column) == F.col("_word"), "left")
        found = F.when(F.col(column).isNotNull(), F.coalesce("_idx", F.lit(self.unki))).cast(kind)
        return out.withColumn(into, found).drop("_word", "_idx")

    def decode_ids(self, df: DataFrame, column: str, into: str = "word", strict: bool = False) -> DataFrame:
        """number -> word; others give ``unk``, or an error if ``strict``."""
        if not isinstance(df.schema[column].dataType, T.IntegralType):
            raise TypeError(f"{column} isn't a number")
        own = self._table().select(F.col("idx").alias("_idx"), F.col("word").alias("_word"))
        other = F.raise_error(F.concat(F.lit("no word has the number "), F.col(column).cast("string"))).cast(self.eltype) if strict else F.lit(self.unk).cast(self.eltype)
        out = df.join(own, F.col(column) == F.col("_idx"), "left")
        return out.withColumn(into, F.when(F.col(column).isNotNull(), F.when(F.col("_word").isNotNull(), F.col("_word")).otherwise(other))).drop("_word", "_idx")

    def lookup(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """The direction by type: texts are encoded, numbers decoded; in a vocabulary of numbers, numbers are decoded."""
        kind = df.schema[column].dataType
        if isinstance(kind, T.StringType):
            return self.encode_ids(df, column, into)
        return self.decode_ids(df, column, into)

    def lookups(self, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """Several columns, each into another; the direction of each by its type."""
        for column, into in columns.items():
            df = self.lookup(df, column, into)
        return df

    def looking(self, column: str, into: str) -> Callable[[DataFrame], DataFrame]:
        """The lookup as a function, for ``DataFrame.transform``."""
        return lambda df: self.lookup(df, column, into)

    def decode_onehot(self, df: DataFrame, column: str, into: str = "word") -> DataFrame:
        """Words of compact one-hot codes, whatever their width; of dense ones (arrays) by the place of their first 1."""
        dense = isinstance(df.schema[column].dataType, T.ArrayType)
        idx = F.array_position(column, F.lit(1)).cast("int") if dense else F.col(column)["idx"]
        return self.decode_ids(df.withColumn("_hot", idx), "_hot", into).drop("_hot")

    def _arrays(self, df: DataFrame, column: str, key: str, into: str, one: Callable[..., DataFrame]) -> DataFrame:
        """A lookup of all elements of arrays, by the row's ``key``."""
        # the outer form, as a plain one would make Spark compute the arrays once more, for a filter
        rows = df.select(F.col(key).alias("_key"), F.posexplode_outer(F.col(column)).alias("_at", "_x")).where("_at is not null")
        done = one(rows, "_x", "_y").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_y"))).alias("_all"))
        back = df.join(done, F.col(key) == F.col("_key"), "left")
        kind = done.schema["_all"].dataType.elementType["_y"].dataType.simpleString()
        found = F.coalesce(F.transform("_all", lambda e: e["_y"]), F.array().cast(f"array<{kind}>"))
        return back.withColumn(into, F.when(F.col(column).isNotNull(), found)).drop("_key", "_all")

    def encode_arrays(self, df: DataFrame, column: str, key: str, into: str = "ids") -> DataFrame:
        return self._arrays(df, column, key, into, self.encode_ids)

    def decode_arrays(self, df: DataFrame, column: str, key: str, into: str = "words") -> DataFrame:
        return self._arrays(df, column, key, into, self.decode_ids)

    def encode_struct(self, df: DataFrame, column: str) -> DataFrame:
        """Every text field of a struct to its number."""
        fields = df.schema[column].dataType.names
        for f in fields:
            df = self.encode_ids(df.withColumn(f"_f_{f}", F.col(column)[f]), f"_f_{f}", f"_n_{f}")
        return df.withColumn(column, F.struct(*[F.col(f"_n_{f}").alias(f) for f in fields])).drop(*[p + f for f in fields for p in ("_f_", "_n_")])

    def onehot(self, idx: Column) -> Column:
        """struct<width, idx>: the compact form of a one-hot vector; 0 is the empty one."""
        return F.struct(F.lit(self.size).alias("width"), idx.cast("int").alias("idx"))

    def onehot_array(self, ids: Column) -> Column:
        return F.struct(F.lit(self.size).alias("width"), ids.cast("array<int>").alias("ids"))

    def onehot_concat(self, *ids: Column) -> Column:
        """Numbers and arrays of them, all in one one-hot array."""
        return self.onehot_array(F.concat(*ids))

    def dense(self, onehot: Column) -> Column:
        """The one-hot vector itself, as an array<int>."""
        return F.transform(F.sequence(F.lit(1), F.lit(max(1, self.size))), lambda k: (k == onehot["idx"]).cast("int"))

    def unknown(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose word the vocabulary lacks."""
        own = self._table().select(F.col("word").alias("_word"))
        return df.join(own, F.col(column) == F.col("_word"), "left_anti")

    def overwrite(self, changes: Mapping[int | str, Any]) -> Vocab:
        """Words replaced at numbers or old words: the number stays, the old word is unknown. Checked on a few rows."""
        old = {r.word: r.idx for r in self.frame.where(F.col("word").isin([k for k in changes if isinstance(k, str)])).collect()} if any(isinstance(k, str) for k in changes) else {}
        new: dict[int, Any] = {}
        for k, word in changes.items():
            if isinstance(k, str) and k not in old:
                raise KeyError(k)
            at = old[k] if isinstance(k, str) else k
            if not 1 <= at <= self.size:
                raise IndexError(at)
            new[at] = word
        if len(set(new.values())) < len(new) or self.frame.where(F.col("word").isin(list(new.values())) & ~F.col("idx").isin(list(new))).limit(1).count():
            raise ValueError("a word would be there twice")
        return Vocab(self._changed(new, "left"), self.unk)

    def perforated(self, changes: Mapping[int, Any]) -> Vocab:
        """As ``overwrite``, with numbers beyond the end allowed: numbers between are holes, which are unknown."""
        if any(k < 1 for k in changes):
            raise IndexError(min(changes))
        if len(set(changes.values())) < len(changes) or self.frame.where(F.col("word").isin(list(changes.values())) & ~F.col("idx").isin(list(changes))).limit(1).count():
            raise ValueError("a word would be there twice")
        return Vocab(self._changed(dict(changes), "full"), self.unk)

    def _changed(self, new: Mapping[int, Any], how: str) -> DataFrame:
        rows = self.frame.sparkSession.createDataFrame(list(new.items()), T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("_new", self.eltype)]))
        return self.frame.join(rows, "idx", how).select("idx", F.coalesce("_new", "word").alias("word"))

    def __repr__(self) -> str:
        return f"Vocab{{{self.eltype.simpleString()}}}(size = {self.size}, unk = {self.unk}, unki = {self.unki})"
