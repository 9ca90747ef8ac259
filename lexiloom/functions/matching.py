"""Patterns: literal quoting, all matches, and splits that keep both matches and gaps.

All patterns are Java regular expressions. Patterns of a list have priority by their order: a later one sees only the
gaps that the earlier ones leave, each gap as a text of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Regex:
    """A Java pattern; ``re.Pattern`` does as well where Python can read it."""

    pattern: str
    flags: int = 0


Pattern = str | re.Pattern | Regex


def literal_match_regex(text: str, flags: str = "") -> str:
    """A pattern of exactly this text; ``flags`` as in ``(?flags)``, such as ``i``."""
    quoted = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""
    return f"(?{flags})" * bool(flags) + quoted


def as_match(pattern: Pattern) -> str:
    """Plain text is quoted, a compiled pattern stands for itself."""
    if isinstance(pattern, (re.Pattern, Regex)):
        flags = "".join(f for f, v in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & v)
        return checked(f"(?{flags})" * bool(flags) + pattern.pattern)
    return checked(literal_match_regex(pattern))


def checked(pattern: str) -> str:
    """Rejects patterns that match nothing at all: an iteration over those wouldn't end."""
    context = SparkContext._active_spark_context
    empty = context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").find() if context else re.search(pattern.replace("\\Q", "").replace("\\E", ""), "")
    if empty:
        raise ValueError(f"pattern {pattern!r} matches the empty text")
    return pattern


def find_all(text: Column, pattern: Pattern) -> Column:
    """All matches, from left to right, not overlapping."""
    return F.regexp_extract_all(text, F.lit(as_match(pattern)), F.lit(0))


def each_split(text: Column, pattern: str) -> Column:
    """Pieces between matches, without empty ones."""
    return F.filter(F.split(text, pattern, -1), lambda x: x != "")


def _pieces(text: Column, pattern: str) -> Column:
    piece = lambda m, x: F.struct(F.lit(m).alias("ismatch"), x.alias("x"))
    # no inner lambda refers to an outer one's variable: Spark wouldn't find a Python function that takes the result
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.filter(F.flatten(F.transform(both, lambda b: F.array(piece(False, b["gap"]), piece(True, b["hit"])))), lambda p: p["x"] != "")


def matchsplits(text: Column, patterns: Pattern | Sequence[Pattern]) -> Column:
    """array<struct<ismatch, x>>: matches and gaps in order, without empty gaps; their texts joined are ``text``."""
    if isinstance(patterns, (str, re.Pattern, Regex)):
        patterns = [patterns]
    if not patterns:
        raise ValueError("matchsplits needs a pattern")
    out = _pieces(text, as_match(patterns[0]))
    for p in patterns[1:]:
        out = F.flatten(F.transform(out, _split_gap(as_match(p))))
    return out


def _split_gap(pattern: str):
    return lambda e: F.when(e["ismatch"], F.array(e)).otherwise(_pieces(e["x"], pattern))
