"""Maps between ranges of code units, as one ``translate``; used to make bytes visible for sub-word models.

The unit width of a side follows from its largest bound: 8, 16 or 32 bits. A text is taken apart into units of the
source width, each unit is mapped (the first range that has it counts; others stay), and units of the target width make
up the new text. 8-bit sources with wider targets work on UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Range = int | str | range | tuple[int | str, int | str]


def code_range(r: Range) -> range:
    """An integer, a character, a range, or (first, last)."""
    point = lambda v: ord(v) if isinstance(v, str) else int(v)
    if isinstance(r, range):
        return r
    if isinstance(r, tuple):
        return range(point(r[0]), point(r[1]) + 1)
    return range(point(r), point(r) + 1)


def codesize(largest: int) -> int:
    """Bits of the smallest unit that holds the value."""
    if largest < 0 or largest > 0x10FFFF:
        raise ValueError(f"not a code unit: {largest}")
    return 8 if largest <= 0xFF else 16 if largest <= 0xFFFF else 32


@dataclass(frozen=True)
class CodeMap:
    """``ranges``: (source, target) pairs of equal lengths."""

    ranges: tuple[tuple[range, range], ...]

    def __init__(self, *ranges: tuple[Range, Range]):
        own = tuple((code_range(a), code_range(b)) for a, b in ranges)
        if not own:
            raise ValueError("a code map needs a range")
        for a, b in own:
            if len(a) != len(b):
                raise ValueError(f"ranges differ in length: {len(a)} and {len(b)}")
        object.__setattr__(self, "ranges", own)

    @property
    def source_bits(self) -> int:
        return codesize(max(max(a) for a, _ in self.ranges))

    @property
    def target_bits(self) -> int:
        return codesize(max(max(b) for _, b in self.ranges))

    def find_code(self, unit: int) -> int:
        for a, b in self.ranges:
            if unit in a:
                return b[a.index(unit)]
        return unit

    def pairs(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for a, b in self.ranges:
            for x, y in zip(a, b, strict=True):
                out.setdefault(x, y)
        return out

    @property
    def on_bytes(self) -> bool:
        """Texts are taken apart into bytes: 8-bit sources that go beyond ASCII or whose targets are wider."""
        return self.source_bits == 8 and (self.target_bits > 8 or max(max(a) for a, _ in self.ranges) > 127)

    def __call__(self, text: Column) -> Column:
        units = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1") if self.on_bytes else text
        return _translate(units, self.pairs())

    def inverse(self) -> CodeUnMap:
        return CodeUnMap(self)

    def __repr__(self) -> str:
        side = lambda r: chr(r[0]) if len(r) == 1 else f"{chr(r[0])!r}:{chr(r[-1])!r}"
        return f"CodeMap{{{self.source_bits} => {self.target_bits}}}({', '.join(f'{side(a)} => {side(b)}' for a, b in self.ranges)})"


@dataclass(frozen=True)
class CodeUnMap:
    """The inverse of a map, for texts that it made."""

    codemap: CodeMap

    def __call__(self, text: Column) -> Column:
        back: dict[int, int] = {}
        for x, y in self.codemap.pairs().items():
            back.setdefault(y, x)
        units = _translate(text, back)
        return F.decode(F.encode(units, "ISO-8859-1"), "UTF-8") if self.codemap.on_bytes else units


def _translate(text: Column, pairs: dict[int, int]) -> Column:
    return F.translate(text, "".join(map(chr, pairs)), "".join(map(chr, pairs.values())))


#: Bytes without a glyph of their own, moved up to letters: the usual map of byte-level sub-word models.
BYTE_MAP = ((range(0, 33), range(256, 289)), (range(127, 161), range(289, 323)), (173, 323))
