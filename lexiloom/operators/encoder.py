"""Encoders: a tokenizer, a vocabulary and what happens to the token texts between them; and the way back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import join_text, sequence_depth
from lexiloom.operators.vocab import Vocab
from lexiloom.plans.nodes import Node
from lexiloom.plans.stages import DOCUMENT, Stage
from lexiloom.plans.tokenization import FlatTokenizer, NestedTokenizer, value


@dataclass(frozen=True, eq=False)
class TextEncoder(Node):
    """``process``: token texts (array<string>, or array<array<string>> of a nested tokenizer) -> what is looked up.

    ``key``: a column that tells rows apart; numbers come back to their rows by it.
    """

    tokenizer: FlatTokenizer | NestedTokenizer
    vocab: Vocab
    process: Callable[[Column], Column] | None = None
    key: str = "doc_id"

    @classmethod
    def build(cls, tokenizer: Any, vocab: Vocab, builder: Callable[[TextEncoder], Callable[[Column], Column]], key: str = "doc_id") -> TextEncoder:
        """``builder`` gets the encoder with its default process and returns the new process."""
        first = cls(tokenizer, vocab, None, key)
        return cls(tokenizer, vocab, builder(first), key)

    def processed(self, tokens: Column) -> Column:
        return self.process(tokens) if self.process else tokens

    def tokenize(self, df: DataFrame, column: str = "text", stage: str | Stage = DOCUMENT) -> DataFrame:
        return df.withColumn("tokens", self.tokenizer.apply(F.col(column), stage))

    def encode_indices(self, df: DataFrame, column: str = "text", stage: str | Stage = DOCUMENT) -> DataFrame:
        """``words``: token texts after the process, not looked up yet."""
        out = self.tokenize(df, column, stage)
        depth = sequence_depth(out, "tokens")
        return out.withColumn("words", self.processed(value(F.col("tokens"), depth))).drop("tokens")

    def lookup(self, df: DataFrame) -> DataFrame:
        """``ids`` of ``words``, of the same shape, and the width of their one-hot form."""
        depth = sequence_depth(df, "words")
        out = _by_leaves(self.vocab.encode_arrays, df, "words", "ids", self.key, depth)
        return out.withColumn("width", F.lit(self.vocab.size))

    def encode(self, df: DataFrame, column: str = "text", stage: str | Stage = DOCUMENT) -> DataFrame:
        return self.lookup(self.encode_indices(df, column, stage)).drop("words")

    def decode_indices(self, df: DataFrame, column: str = "ids", into: str = "words") -> DataFrame:
        return _by_leaves(self.vocab.decode_arrays, df, column, into, self.key, sequence_depth(df, column))

    decode = decode_indices

    def decode_text(self, df: DataFrame, column: str = "ids", delim: str = " ", into: str = "decoded") -> DataFrame:
        words = self.decode_indices(df, column, "_words")
        return words.withColumn(into, join_text(F.col("_words"), delim, depth=sequence_depth(words, "_words"))).drop("_words")

    def __repr__(self) -> str:
        return f"TextEncoder({self.tokenizer!r}, {self.vocab!r})"


def _by_leaves(look: Callable[..., DataFrame], df: DataFrame, column: str, into: str, key: str, depth: int) -> DataFrame:
    """A lookup of arrays' elements, for arrays of arrays too: flattened, looked up, and cut into the old shape."""
    if depth == 1:
        return look(df, column, key, into)
    sizes = F.transform(column, lambda s: F.size(s))
    flat = df.withColumn("_flat", F.flatten(column)).withColumn("_sizes", sizes)
    if depth > 2:
        raise TypeError("lookups of arrays more than two levels deep aren't possible")
    out = look(flat, "_flat", key, "_got")
    ends = F.aggregate("_sizes", F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    cut = F.transform(F.col("_sizes"), lambda n, i: F.slice(F.col("_got"), F.get(F.col("_ends"), i) + 1, n))
    return out.withColumn("_ends", ends).withColumn(into, cut).drop("_flat", "_sizes", "_got", "_ends")


