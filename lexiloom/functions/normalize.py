"""Text normalization as functions Column -> Column; those that Spark has no expression for are ``PythonText``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.columns import let

FORMS = ("NFC", "NFD", "NFKC", "NFKD")

#: Texts of an Arrow batch that are Python objects at a time.
_AT_ONCE = 500


@dataclass(frozen=True)
class PythonText:
    """A Python function str -> str, run on Arrow batches; plans hoist it out of lambdas, over whole (nested) arrays."""

    f: Callable[[str], str]
    name: str = "python"

    def __call__(self, text: Column, depth: int = 0) -> Column:
        return self._run(text, T.StringType(), depth)

    def on_gaps(self, pieces: Column, depth: int) -> Column:
        """On arrays, ``depth`` deep, of (ismatch, x): x where it is no match."""
        return self._run(pieces, T.StructType([T.StructField("ismatch", T.BooleanType()), T.StructField("x", T.StringType())]), depth)

    def _run(self, column: Column, kind: T.DataType, depth: int) -> Column:
        f = self.f
        for _ in range(depth):
            kind = T.ArrayType(kind)

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            return _leaves(f, values)

        return run(column)


def _leaves(f: Callable[[str], str], a: pa.Array) -> pa.Array:
    """``f`` on all texts of (nested) arrays; of (ismatch, x) on those that aren't a match."""
    if isinstance(a, (pa.ListArray, pa.LargeListArray)):
        return type(a).from_arrays(pa.array(a.offsets.to_numpy(), a.offsets.type), _leaves(f, a.values), mask=a.is_null() if a.null_count else None)
    if len(a) > _AT_ONCE:
        return pa.concat_arrays([_leaves(f, a.slice(k, _AT_ONCE)) for k in range(0, len(a), _AT_ONCE)])
    if isinstance(a, pa.StructArray):
        match, x = a.field("ismatch"), a.field("x")
        new = pa.array([v if m else None if v is None else f(v) for m, v in zip(match.to_pylist(), x.to_pylist(), strict=True)], x.type)
        return pa.StructArray.from_arrays([match, new], ["ismatch", "x"])
    return pa.array([None if v is None else f(v) for v in a.to_pylist()], a.type)


def lowercase(text: Column) -> Column:
    """Lower case, code point by code point: no final sigma, no two code points for one."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def casefold(text: Column) -> Column:
    """Full case folding by upper and lower case; the dotless i stays as it is."""
    kept = F.translate(text, "\u0131", "\ue131")
    return F.translate(F.lower(F.translate(F.upper(kept), "\u03a3", "\u03c3")), "\ue131\u03c2", "\u0131\u03c3")


def normal_form(form: str) -> Callable[[Column], Column]:
    """A Unicode normal form, by the ICU that Spark has; no text goes to Python, whose tables it follows."""
    if form not in FORMS:
        raise ValueError(f"not a normal form: {form}; one of {', '.join(FORMS)}")
    return _Form(form)


#: Code points that ICU 77 (Unicode 16) changes, reorders or composes and Python 3.13 (Unicode 15.1) has as unassigned. They stay as they are, and what is beside them is normalized by itself.
_NEWER = r"[\x{897}\x{105C9}\x{105D2}\x{105DA}\x{105E4}\x{10D69}-\x{10D6D}\x{11382}-\x{11385}\x{1138B}\x{1138E}\x{11390}-\x{11391}\x{113B8}\x{113BB}\x{113C2}\x{113C5}\x{113C7}-\x{113C9}\x{113CE}-\x{113D0}\x{1611E}-\x{16129}\x{1612F}\x{16D63}\x{16D67}-\x{16D6A}\x{1CCD6}-\x{1CCF9}\x{1E5EE}-\x{1E5EF}]"
#: A wider, quicker class, which hardly any text has.
_ROUGHLY = r"[\x{897}\x{105C9}-\x{1E5EF}]"


@dataclass(frozen=True)
class _Form:
    form: str

    def __call__(self, text: Column) -> Column:
        return let(text, lambda t: F.when(t.rlike(_ROUGHLY) & t.rlike(_NEWER), self._between(t)).when(t.isNotNull(), self._whole(t)))

    def _whole(self, t: Column) -> Column:
        how = "compose" if self.form.endswith("C") else "decompose"
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(how), t, F.lit("K" in self.form))

    def _between(self, t: Column) -> Column:
        both = F.arrays_zip(F.split(t, _NEWER, -1).alias("gap"), F.regexp_extract_all(t, F.lit(_NEWER), F.lit(0)).alias("hit"))
        return F.array_join(F.transform(both, lambda b: F.concat(self._whole(b["gap"]), F.coalesce(b["hit"], F.lit("")))), "")


def _no_unassigned(x: str) -> str:
    for c in x:
        if unicodedata.category(c) == "Cn":
            raise ValueError(f"unassigned code point U+{ord(c):04X}")
    return x


_IGNORABLE = r"[\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0\uFFF0-\uFFF8\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
_NEWLINE = "\r\n|[\n\r\u0085\u000b\u000c]"
_LUMP = ("\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2018\u2019\u02bc\u02c8\u2010\u2011\u2012\u2013\u2014\u2212\u2044\u2215\u2223\u2236\u2039\u2329\u3008\u203a\u232a\u3009\u02c6\u02cd\u02dc\u223c", " " * 15 + "''''" + "------" + "//" + "|" + ":" + "<<<" + ">>>" + "^_~~")

#: Flags in the order in which they're printed.
FLAGS = ("stable", "compat", "compose", "decompose", "stripignore", "rejectna", "newline2ls", "newline2ps", "newline2lf", "stripcc", "casefold", "lump", "stripmark")


@dataclass(frozen=True)
class UnicodeFlags:
    """Steps of a Unicode normalization; all flags but ``compose`` are off unless given."""

    on: frozenset = field(default_factory=lambda: frozenset({"compose"}))

    @classmethod
    def of(cls, **flags: bool) -> UnicodeFlags:
        bad = set(flags) - set(FLAGS)
        if bad:
            raise ValueError(f"no such flags: {', '.join(sorted(bad))}")
        on = {"compose"} if flags.get("compose", True) else set()
        on |= {k for k, v in flags.items() if v}
        if on & {"compat", "stripmark"} and not on & {"compose", "decompose"}:
            raise ValueError("compat and stripmark need compose or decompose")
        if len(on & {"newline2ls", "newline2ps", "newline2lf"}) > 1:
            raise ValueError("only one conversion of newlines is possible")
        return cls(frozenset(on))

    @classmethod
    def named(cls, form: str) -> UnicodeFlags:
        if form not in FORMS:
            raise ValueError(f"not a normal form: {form}; one of {', '.join(FORMS)}")
        return cls(frozenset({"stable", "compose" if form.endswith("C") else "decompose"} | ({"compat"} if "K" in form else set())))

    @property
    def form(self) -> str | None:
        if not self.on & {"compose", "decompose"}:
            return None
        return "NF" + "K" * ("compat" in self.on) + ("D" if "decompose" in self.on else "C")

    def steps(self) -> list[Callable[[Column], Column]]:
        """Native functions and ``PythonText``, to be run in this order."""
        on, out = self.on, []
        if "rejectna" in on:
            out.append(PythonText(_no_unassigned, "rejectna"))
        if "casefold" in on:
            out.append(casefold)
        if "stripmark" in on:
            out += [normal_form("NFKD" if "compat" in on else "NFD"), lambda t: F.regexp_replace(t, r"\p{M}+", "")]
        if "stripignore" in on:
            out.append(lambda t: F.regexp_replace(t, _IGNORABLE, ""))
        for flag, new in (("newline2ls", "\u2028"), ("newline2ps", "\u2029"), ("newline2lf", "\n")):
            if flag in on:
                out.append(_replacer(_NEWLINE, new))
        if "stripcc" in on:
            newline = on & {"newline2ls", "newline2ps", "newline2lf"}
            out += [_replacer(_NEWLINE, "\n" if "newline2lf" in newline else " ") if not newline else (lambda t: t), lambda t: F.regexp_replace(F.translate(t, "\t", " "), r"[\p{Cc}&&[^\n]]" if "newline2lf" in newline else r"\p{Cc}", "")]
        if "lump" in on:
            out.append(lambda t: F.translate(t, *_LUMP))
        if self.form:
            out.append(normal_form(self.form))
        return out

    def __repr__(self) -> str:
        for form in FORMS:
            if self.on == self.named(form).on:
                return form
        return ", ".join(f"{f} = true" for f in FLAGS if f in self.on)


def _replacer(pattern: str, new: str) -> Callable[[Column], Column]:
    return lambda t: F.regexp_replace(t, pattern, new)


def replaced(pattern: str, replacement: str) -> Callable[[Column], Column]:
    """Regular-expression replacement; groups as \\1 or $1."""
    return _replacer(pattern, re.sub(r"\\(\d)", r"$\1", replacement))


def composed(functions: Sequence[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    def run(t: Column) -> Column:
        for f in functions:
            t = f(t)
        return t

    return run
