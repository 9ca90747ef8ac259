"""Stages: what a text column holds. A stage is part of the plan, not of the data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A kind of text; ``parent`` is the kind it counts as."""

    name: str
    parent: Stage | None = None

    def is_a(self, other: Stage) -> bool:
        return self == other or (self.parent is not None and self.parent.is_a(other))

    def __repr__(self) -> str:
        return self.name


TEXT = Stage("text")
DOCUMENT, SENTENCE, SUBSENTENCE, WORD, SUBWORD, TOKEN = (Stage(n, TEXT) for n in ("document", "sentence", "subsentence", "word", "subword", "token"))
STAGES: dict[str, Stage] = {s.name: s for s in (TEXT, DOCUMENT, SENTENCE, SUBSENTENCE, WORD, SUBWORD, TOKEN)}
#: What the parts of a split stage are.
NEXT = {DOCUMENT: SENTENCE, SENTENCE: WORD, SUBSENTENCE: WORD, WORD: TOKEN, SUBWORD: TOKEN}


def register_stage(name: str, parent: str | Stage = SENTENCE) -> Stage:
    """A stage of one's own that is treated like its parent."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a stage name: {name!r}")
    if name in STAGES:
        raise ValueError(f"there is a stage {name}")
    up = stage(parent)
    STAGES[name] = Stage(name, up)
    return STAGES[name]


def stage(s: str | Stage) -> Stage:
    if isinstance(s, Stage):
        return s
    if s not in STAGES:
        raise ValueError(f"no stage {s!r}; one of {', '.join(STAGES)}")
    return STAGES[s]


def kind(s: str | Stage) -> Stage:
    """The built-in stage that a stage is treated as."""
    own = stage(s)
    while own not in NEXT and own not in (TOKEN, TEXT):
        own = own.parent
    if own is TEXT:
        raise ValueError(f"stage {s} has no splitting")
    return own


# ---- tokens: struct<x, metadata ...> ----


def token(x: Column, **meta: Column) -> Column:
    return F.struct(x.alias("x"), *[v.alias(k) for k, v in meta.items()])


def getvalue(tok: Column) -> Column:
    return tok["x"]


def getmeta(tok: Column, field: str) -> Column:
    return tok[field]


def hasmeta(df: DataFrame, column: str, field: str) -> bool:
    """Whether tokens of the column (a struct, or arrays of it) have the metadata field."""
    t = df.schema[column].dataType
    while hasattr(t, "elementType"):
        t = t.elementType
    return field in getattr(t, "names", [])


def setvalue(tok: Column, x: Column) -> Column:
    return tok.withField("x", x)


def updatevalue(f, tok: Column) -> Column:
    return tok.withField("x", f(tok["x"]))


def updatemeta(tok: Column, **meta: Column) -> Column:
    """Metadata merged in, the new values winning."""
    for k, v in meta.items():
        tok = tok.withField(k, v)
    return tok


setmeta = updatemeta


@dataclass(frozen=True)
class Batch:
    """Rows, or the elements of an array column, as texts of one stage."""

    of: Stage

    def rows(self, df: DataFrame, column: str, *keep: str, ordinal: str = "ordinal") -> DataFrame:
        """A row for each element of the array column, with its 1-based place."""
        out = df.select(*keep, F.posexplode(column).alias("_at", "_x"))
        return out.select(*keep, (F.col("_at") + 1).alias(ordinal), F.col("_x").alias(column))

    def __repr__(self) -> str:
        return f"Batch{{{self.of}}}"
