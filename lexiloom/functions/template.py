"""Sequence templates: how several sequences and constants make up one, with a type id for each element.

A template compiles to two columns; the one that isn't used is pruned. Inputs are array columns, or one
``array<array>`` column whose number of sequences may differ by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class InputTerm:
    """The next input."""

    type_id: int = 1

    def __repr__(self) -> str:
        return f"Input:<type={self.type_id}>"


@dataclass(frozen=True)
class IndexInputTerm:
    """The input of this number, from 1; if it is the next one, it is used up."""

    index: int
    type_id: int = 1

    def __repr__(self) -> str:
        return f"Input[{self.index}]:<type={self.type_id}>"


@dataclass(frozen=True)
class ConstTerm:
    """A constant."""

    value: Any
    type_id: int = 1

    def __repr__(self) -> str:
        return f"{self.value}:<type={self.type_id}>"


@dataclass(frozen=True)
class RepeatedTerm:
    """Terms repeated while inputs remain that no later term needs; each time all type ids grow by ``dynamic_type_id``."""

    terms: tuple[InputTerm | IndexInputTerm | ConstTerm, ...]
    dynamic_type_id: int = 0

    def __init__(self, *terms: Any, dynamic_type_id: int | bool = 0):
        if any(isinstance(t, RepeatedTerm) for t in terms):
            raise ValueError("repeated terms can't be nested")
        if not any(isinstance(t, InputTerm) for t in terms):
            raise ValueError("a repeated term has to use up an input")
        object.__setattr__(self, "terms", terms)
        object.__setattr__(self, "dynamic_type_id", int(dynamic_type_id))

    @property
    def width(self) -> int:
        return sum(isinstance(t, InputTerm) for t in self.terms)

    def __repr__(self) -> str:
        grow = f"<type+={self.dynamic_type_id}>" if self.dynamic_type_id else ""
        return f"({' '.join(map(repr, self.terms))}){grow}..."


@dataclass(frozen=True)
class SequenceTemplate:
    terms: tuple[Any, ...]
    kind: str = "string"

    def __init__(self, *terms: Any, kind: str = "string"):
        if not terms:
            raise ValueError("a template needs a term")
        if sum(isinstance(t, RepeatedTerm) for t in terms) > 1:
            raise ValueError("a template has one repeated term at most")
        object.__setattr__(self, "terms", terms)
        object.__setattr__(self, "kind", kind)

    def _plan(self, n: int) -> list[tuple[Any, int | None, int]]:
        """(term, input from 0 or None, growth of its type id) for ``n`` inputs."""
        out, at = [], 0
        later = [sum(isinstance(t, InputTerm) for t in self.terms[k + 1 :]) for k in range(len(self.terms))]

        def one(t: Any, grow: int) -> None:
            nonlocal at
            if isinstance(t, ConstTerm):
                out.append((t, None, grow))
            elif isinstance(t, IndexInputTerm):
                if not 1 <= t.index <= n:
                    raise ValueError(f"no input {t.index} of {n}")
                out.append((t, t.index - 1, grow))
                at += t.index - 1 == at
            else:
                if at >= n:
                    raise ValueError(f"too few inputs: {n}")
                out.append((t, at, grow))
                at += 1

        for k, t in enumerate(self.terms):
            if isinstance(t, RepeatedTerm):
                grow = 0
                while n - at > later[k]:
                    for inner in t.terms:
                        one(inner, grow)
                    grow += t.dynamic_type_id
            else:
                one(t, 0)
        if at < n:
            raise ValueError(f"{n - at} of {n} inputs aren't used")
        return out

    def __call__(self, *inputs: Column) -> tuple[Column, Column]:
        """(sequence, type ids) of the array columns."""
        seq, ids = [], []
        for t, at, grow in self._plan(len(inputs)):
            if at is None:
                seq.append(F.array(F.lit(t.value)).cast(f"array<{self.kind}>"))
                ids.append(F.array(F.lit(t.type_id + grow)))
            else:
                seq.append(inputs[at].cast(f"array<{self.kind}>"))
                ids.append(F.array_repeat(F.lit(t.type_id + grow), F.size(inputs[at])))
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        return F.concat(empty(self.kind), *seq), F.concat(empty("int"), *ids)

    def sequence(self, *inputs: Column) -> Column:
        return self(*inputs)[0]

    def type_ids(self, *inputs: Column) -> Column:
        return self(*inputs)[1]

    def validate(self, n: int) -> None:
        """Raises unless ``n`` inputs fit."""
        self._plan(n)

    def over(self, inputs: Column) -> tuple[Column, Column]:
        """(sequence, type ids) of one array<array> column; rows whose number of inputs doesn't fit raise an error."""
        return self._over(inputs, True), self._over(inputs, False)

    def _over(self, xs: Column, seq: bool) -> Column:
        kind = self.kind if seq else "int"
        n = F.size(xs)
        k = next((i for i, t in enumerate(self.terms) if isinstance(t, RepeatedTerm)), len(self.terms))
        before, after = self.terms[:k], self.terms[k + 1 :]
        rep: RepeatedTerm | None = self.terms[k] if k < len(self.terms) else None

        def used(terms: Sequence[Any], at: int) -> int:
            for t in terms:
                at += isinstance(t, InputTerm) or (isinstance(t, IndexInputTerm) and t.index - 1 == at)
            return at

        first = used(before, 0)
        tail = sum(isinstance(t, InputTerm) for t in after)

        def part(t: Any, at: Column | None, grow: Column) -> Column:
            if isinstance(t, ConstTerm):
                return F.array(F.lit(t.value)).cast(f"array<{kind}>") if seq else F.array(F.lit(t.type_id) + grow)
            own = F.get(xs, F.lit(t.index - 1) if isinstance(t, IndexInputTerm) else at)
            return own.cast(f"array<{kind}>") if seq else F.array_repeat(F.lit(t.type_id) + grow, F.size(own))

        def run(terms: Sequence[Any], start: Column, grow: Column) -> list[Column]:
            out, step = [], 0
            for t in terms:
                out.append(part(t, start + step, grow))
                step += isinstance(t, InputTerm)
            return out

        def run_before() -> list[Column]:
            out, at = [], 0
            for t in before:
                out.append(part(t, F.lit(at), F.lit(0)))
                at = used([t], at)
            return out

        pieces = [F.array().cast(f"array<{kind}>"), *run_before()]
        if rep:
            free = n - first - tail
            times = F.ceil(F.greatest(free, F.lit(0)) / F.lit(rep.width)).cast("int")
            groups = F.when(times > 0, F.transform(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0))), lambda g: F.concat(*run(rep.terms, F.lit(first) + g * rep.width, g * rep.dynamic_type_id)))).otherwise(F.array().cast(f"array<array<{kind}>>"))
            pieces += [F.flatten(groups), *run(after, first + times * rep.width, F.lit(0))]
            fits = (free >= 0) & (F.greatest(free, F.lit(0)) % rep.width == 0)
        else:
            fits = n == first
        wrong = F.raise_error(F.concat(F.lit("the template doesn't fit inputs: "), n.cast("string")))
        for t in self.terms if not rep else (*before, *rep.terms, *after):
            if isinstance(t, IndexInputTerm):
                fits = fits & (n >= t.index)
        return F.when(xs.isNull(), F.lit(None)).when(fits, F.concat(*pieces)).otherwise(wrong.cast(f"array<{kind}>"))

    def nested(self, inputs: Column) -> tuple[Column, Column]:
        """As ``over``, for an array of samples, each an array of inputs."""
        return F.transform(inputs, lambda x: self._over(x, True)), F.transform(inputs, lambda x: self._over(x, False))

    def __repr__(self) -> str:
        return f"SequenceTemplate{{{self.kind}}}({' '.join(map(repr, self.terms))})"


