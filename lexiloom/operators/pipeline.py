"""Pipelines: named columns computed one after another from a source column and from each other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Stand for the source column, and for a struct of all columns but it.
SOURCE, TARGET = 0, 1


@dataclass(frozen=True)
class Pipeline:
    """``names`` = f of ``fields``: column names, ``SOURCE`` or ``TARGET``. Several names unpack a struct in its order."""

    names: str | tuple[str, ...]
    f: Callable[..., Column]
    fields: str | int | tuple[str | int, ...] = 0

    def apply(self, df: DataFrame, source: str) -> DataFrame:
        fields = self.fields if isinstance(self.fields, tuple) else (self.fields,)
        target = lambda: F.struct(*[c for c in df.columns if c != source])
        value = self.f(*[F.col(source) if x == SOURCE else target() if x == TARGET else F.col(x) for x in fields])
        if isinstance(self.names, str):
            return df.withColumn(self.names, value)
        out = df.withColumn("_value", value)
        parts = out.schema["_value"].dataType.names
        if len(parts) != len(self.names):
            raise ValueError(f"{len(self.names)} names for {len(parts)} values")
        return out.withColumns({n: F.col("_value")[p] for n, p in zip(self.names, parts, strict=True)}).drop("_value")

    def __or__(self, other: Pipeline | Pipelines | PipeGet) -> Pipelines:
        return Pipelines((self,)) | other

    def __repr__(self) -> str:
        names = self.names if isinstance(self.names, str) else f"({', '.join(self.names)})"
        fields = self.fields if isinstance(self.fields, tuple) else (self.fields,)
        shown = ", ".join({SOURCE: "source", TARGET: "target"}.get(x, f"target.{x}") for x in fields)
        return f"target[{names}] := {getattr(self.f, '__name__', repr(self.f))}({shown})"


@dataclass(frozen=True)
class PipeGet:
    """Only these columns, with those that identify the row."""

    names: tuple[str, ...]

    def __init__(self, *names: str):
        object.__setattr__(self, "names", names)

    def apply(self, df: DataFrame, source: str) -> DataFrame:
        return df.select(*self.names)

    def __repr__(self) -> str:
        return f"target := ({', '.join(f'target.{n}' for n in self.names)})"


@dataclass(frozen=True)
class Pipelines:
    """Steps in order; they can be taken apart and put together."""

    steps: tuple[Pipeline | PipeGet, ...]

    def __or__(self, other: Pipeline | Pipelines | PipeGet) -> Pipelines:
        return Pipelines((*self.steps, *(other.steps if isinstance(other, Pipelines) else (other,))))

    def __getitem__(self, k: int | slice) -> Pipeline | PipeGet | Pipelines:
        return Pipelines(self.steps[k]) if isinstance(k, slice) else self.steps[k]

    def __len__(self) -> int:
        return len(self.steps)

    def __call__(self, df: DataFrame, source: str = "text") -> DataFrame:
        return reduce(lambda d, step: step.apply(d, source), self.steps, df)

    def __repr__(self) -> str:
        return "\n  ".join(["Pipelines:", *map(repr, self.steps)])
