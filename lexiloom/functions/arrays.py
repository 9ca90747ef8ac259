"""Sequences: nested arrays, heads and tails, truncation and padding, rectangular batches, joined text.

``depth`` is the number of array levels of the column; the innermost arrays are the sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let, nested

nestedcall = nested


def sequence_depth(df: DataFrame, column: str) -> int:
    """Array levels of a column."""
    t, n = df.schema[column].dataType, 0
    while isinstance(t, T.ArrayType):
        t, n = t.elementType, n + 1
    return n


def nestedtype(df: DataFrame, column: str) -> T.DataType:
    t = df.schema[column].dataType
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t


def _lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def with_head_tail(x: Column | None = None, head: Any = None, tail: Any = None, depth: int = 1) -> Any:
    """``head`` before and ``tail`` after every sequence, either may be None. Without ``x``, the function itself."""
    if x is None:
        return lambda c: with_head_tail(c, head, tail, depth)
    parts = lambda s: [*([F.array(_lit(head))] if head is not None else []), s, *([F.array(_lit(tail))] if tail is not None else [])]
    return nested(lambda s: F.concat(*parts(s)) if head is not None or tail is not None else s, depth - 1)(x)


def _ends(trunc_end: str, pad_end: str) -> None:
    for name, end in (("trunc_end", trunc_end), ("pad_end", pad_end)):
        if end not in ("head", "tail"):
            raise ValueError(f"{name} is head or tail, not {end!r}")


def trunc_or_pad(x: Column | None, n: int | Column | None, pad: Any, trunc_end: str = "tail", pad_end: str = "tail", depth: int = 1) -> Any:
    """Every sequence cut or padded to ``n``; None: to the longest one of this value. Without ``x``, the function itself."""
    _ends(trunc_end, pad_end)
    if x is None:
        return lambda c: trunc_or_pad(c, n, pad, trunc_end, pad_end, depth)

    def fixed(s: Column, size: Column) -> Column:
        cut = F.slice(s, F.lit(1), size) if trunc_end == "tail" else F.slice(s, F.size(s) - size + 1, size)
        more = F.array_repeat(_lit(pad), size - F.size(s))
        return F.when(F.size(s) > size, cut).otherwise(F.concat(s, more) if pad_end == "tail" else F.concat(more, s))

    if n is None:
        return let(nestedmaxlength(x, depth), lambda m: nested(lambda s: fixed(s, m), depth - 1)(x))
    return nested(lambda s: fixed(s, _lit(n)), depth - 1)(x)


def trunc_and_pad(x: Column | None, most: int | None, pad: Any, trunc_end: str = "tail", pad_end: str = "tail", depth: int = 1) -> Any:
    """Every sequence cut or padded to the longest one's length, but to no more than ``most``."""
    _ends(trunc_end, pad_end)
    if x is None:
        return lambda c: trunc_and_pad(c, most, pad, trunc_end, pad_end, depth)
    if most is None:
        return trunc_or_pad(x, None, pad, trunc_end, pad_end, depth)
    return let(F.least(nestedmaxlength(x, depth), F.lit(most)), lambda m: trunc_or_pad(x, m, pad, trunc_end, pad_end, depth))


def pad_batch(df: DataFrame, column: str, pad: Any, most: int | None = None, batch_key: str | None = None, trunc_end: str = "tail", pad_end: str = "tail", depth: int = 1) -> DataFrame:
    """As ``trunc_and_pad``, over all rows of a batch, or of the frame.

    The longest length is an aggregate that comes back by a join, so a batch of any size is spread; without a key it is
    one row.
    """
    size = nestedmaxlength(F.col(column), depth)
    keys = [batch_key] if batch_key else []
    most_of = df.groupBy(*keys).agg(F.max(size).alias("_most"))
    back = df.join(most_of, batch_key, "left") if batch_key else df.crossJoin(F.broadcast(most_of))  # one row
    target = F.least("_most", F.lit(most)) if most is not None else F.col("_most")
    return back.withColumn(column, trunc_or_pad(F.col(column), target, pad, trunc_end, pad_end, depth)).select(*df.columns)


def nestedmaxlength(x: Column, depth: int = 1) -> Column:
    """Length of the longest sequence; 0 of none."""
    if depth == 1:
        return F.size(x)
    return F.coalesce(F.array_max(F.transform(x, lambda s: nestedmaxlength(s, depth - 1))), F.lit(0))


def nestedsize(x: Column, depth: int = 1) -> Column:
    """Lengths of all levels, innermost first; an error where arrays of one level differ."""

    def level(k: int) -> Column:
        flat = x
        for _ in range(k - 1):
            flat = F.flatten(flat)
        if k == 0:
            return F.size(x)
        sizes = F.transform(flat, lambda s: F.size(s))
        return let(sizes, lambda s: F.when(F.size(s) == 0, F.lit(0)).when(F.array_min(s) == F.array_max(s), F.get(s, F.lit(0))).otherwise(F.raise_error(F.lit("arrays of one level differ in length")).cast("int")))

    return F.array(*[level(k) for k in range(depth - 1, -1, -1)])


def nested2batch(x: Column, depth: int = 1) -> Column:
    """struct<shape, data>: a rectangular array, its values with the innermost level running fastest."""
    data = x
    for _ in range(depth - 1):
        data = F.flatten(data)
    return F.struct(nestedsize(x, depth).alias("shape"), data.alias("data"))


def batch2nested(batch: Column, depth: int) -> Column:
    """The nested arrays of a rectangular array."""
    out = batch["data"]
    for k in range(depth - 1):
        out = _chunks(out, F.get(batch["shape"], F.lit(k)))
    return out


def _chunks(a: Column, width: Column) -> Column:
    count = F.floor(F.size(a) / F.greatest(width, F.lit(1))).cast("int")
    return F.when(count == 0, F.slice(F.array(a), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(a, i * width + 1, width)))


def join_text(x: Column, delim: str = "", last: str | None = None, depth: int = 1) -> Column:
    """Innermost arrays as texts; ``last`` stands before the last part."""

    def one(s: Column) -> Column:
        if last is None:
            return F.array_join(s, delim)
        n = F.size(s)
        return F.when(n < 2, F.array_join(s, delim)).otherwise(F.concat(F.array_join(F.slice(s, F.lit(1), n - 1), delim), F.lit(last), F.element_at(s, -1)))

    return nested(one, depth - 1)(x)


def allany(f: Callable[[Column], Column], x: Column) -> Column:
    """struct<all, any>."""
    return F.struct(F.forall(x, f).alias("all"), F.exists(x, f).alias("any"))


def elementmap(f: Callable[[Column], Column], x: Column, depth: int = 1) -> Column:
    return nested(f, depth)(x)


def ordinal(order_by: str, *keys: str) -> Column:
    """1-based place within the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))
