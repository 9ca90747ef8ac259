"""Small helpers over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nested(f: Callable[[Column], Column], depth: int) -> Callable[[Column], Column]:
    """``f`` applied at the leaves of arrays ``depth`` deep."""
    if depth == 0:
        return f
    inner = nested(f, depth - 1)
    return lambda c: F.transform(c, lambda x: inner(x))


def lit_array(values: list, kind: str) -> Column:
    """An array literal, also of no values."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
