"""Sentence and word splitters: Column -> array<string>. They're the defaults of plans; any function like them will do.

The rules are those of common practice for English-like text (sentence ends, Penn-treebank words); quotes stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends after ., ! or ? and closing marks, before white space and an upper-case letter, a digit or an opening mark.
_BORDER = r"(?<=[.!?][\"')\]\u201d\u2019]{0,3})(?<!\b(?:Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e)\.)\s+(?=[\p{Lu}\p{N}\"'(\[\u201c\u2018])|\s*\n\s*\n\s*"
_CONTRACTIONS = r"(?i)(?<=\p{L})('ll|'re|'ve|n't|'s|'m|'d)(?!\p{L})"


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _BORDER, -1), lambda s: F.trim(s)), lambda s: s != "")


def newline_sentences(text: Column) -> Column:
    """A sentence a line."""
    return F.filter(F.split(text, "\n", -1), lambda s: s != "")


def words(text: Column) -> Column:
    """Punctuation marks by themselves, the last period too; contractions in two parts; numbers whole."""
    out = F.regexp_replace(text, r"\.{3}", " ... ")
    out = F.regexp_replace(out, r"([^\p{L}\p{M}\p{N}_\s.,:'\-])", " $1 ")
    out = F.regexp_replace(out, r"([,:])(?!\p{N})", " $1 ")
    out = F.regexp_replace(out, r"(?<![.\s])(\.)(?=[\s\])}>\"']*$)", " $1 ")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{M}\p{N}])'|'(?![\p{L}\p{M}\p{N}])", " ' ")
    out = F.regexp_replace(out, _CONTRACTIONS, " $1")
    return F.filter(F.split(out, r"\s+", -1), lambda w: w != "")


def blank_words(text: Column) -> Column:
    """Runs of anything but space, tab, line feed and carriage return."""
    return F.filter(F.split(text, "[ \t\r\n]+", -1), lambda w: w != "")


def loose_words(text: Column) -> Column:
    """Words by white space, with marks at a word's end dropped."""
    out = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s'\-]+(?=\s|$)", " ")
    return F.filter(F.split(out, r"\s+", -1), lambda w: w != "")


def characters(word: Column) -> Column:
    """A word's code points."""
    return F.filter(F.split(word, "", -1), lambda c: c != "")


#: Words with a blank before, contractions, numbers, marks and blanks; for byte-level sub-word models.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def word_pieces(vocabulary: list[str], unknown: str = "[UNK]", prefix: str = "##", most: int = 200):
    """A word splitter for a small vocabulary: the longest known piece first, further ones with ``prefix``.

    Words of over ``most`` code points and words with an unknown rest are ``unknown``. Every step tries all lengths of
    the vocabulary, so its cost grows with the longest piece.
    """
    known = F.array(*[F.lit(v) for v in vocabulary])
    longest = max(len(v) for v in vocabulary)

    def split(word: Column) -> Column:
        n = F.length(word)

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            name = lambda k: F.concat(F.when(at > 0, F.lit(prefix)).otherwise(F.lit("")), F.substring(word, at + 1, k))
            sizes = F.filter(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda k: (at + k <= n) & F.array_contains(known, name(k)))
            size = F.get(sizes, F.lit(0))
            return F.when(acc["bad"] | (at >= n), acc).when(size.isNull(), F.struct(at.alias("at"), F.lit(True).alias("bad"), acc["out"].alias("out"))).otherwise(F.struct((at + size).alias("at"), F.lit(False).alias("bad"), F.array_append(acc["out"], name(size)).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("out"))
        run = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda a: F.when(a["bad"], F.array(F.lit(unknown))).otherwise(a["out"]))
        return F.when(n > most, F.array(F.lit(unknown))).otherwise(run)

    return split
