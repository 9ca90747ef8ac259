"""Quality rules with risk-controlled thresholds (operator 2), with DataFrame operations only.

Fixed rules reject texts of under ``LEAST_WORDS`` words, or with more than half their words in repeated 3-word windows.
The other rules compare ratios with cutoffs that labelled documents select, per stratum (language):

- all rules are tightened together along a path that is fixed beforehand: ``STEPS`` vectors of cutoffs, from loose to
  strict, each step tightening one rule;
- the labelled good documents that a step's verdict (any rule) rejects are binomial, and a step is certified if the
  exact binomial tail P(X <= k | n, ``RISK``) is at most its error level, that is, if the Clopper-Pearson upper bound of
  the verdict's false rejection rate is at most ``RISK``;
- steps are tested in order until one isn't certified (fixed sequence, which needs no further correction); the strata
  share ``ERROR`` equally (Bonferroni);
- of the certified steps the one that tells bad from good best is taken, the loosest of equals; if none is, or a stratum
  has too few labels to certify any, the learned rules reject nothing there.

So with probability 1 - ERROR, in every stratum the learned verdict falsely rejects at most a share RISK of the good
documents that pass the fixed rules. With m strata a step without a single false rejection needs
log(ERROR / m) / log(1 - RISK) good labels: 217 for four. A trial is a doc_id, and of equal texts one.

A null text has no words. A null stratum is a stratum of its own. Labels that are null don't count; documents labelled
more than once count as bad if any label is. Rows with one doc_id are judged one by one. Texts of 2 ** 26 words or more
have their windows sorted by words, not by hash. Ratios equal to a cutoff pass. Extra columns stay or are ignored,
whatever their names. Empty tables: no rows, no cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let, table, written

LEAST_WORDS, MOST_REPEATED = 50, 50
RISK, ERROR = 0.02, 0.05
#: So many labelled ids (some 16 MB) are broadcast to pick the rows to measure for the cutoffs.
BROADCAST_IDS = 1_000_000
#: Rule -> ratio and its cutoffs, loose to strict; a value above its cutoff rejects.
RULES: dict[str, tuple[Callable[[Callable[[str], Column]], Column], tuple[float, ...]]] = {
    "symbols": (lambda f: f("n_symbols") / F.greatest(f("n_words"), F.lit(1)), (5.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "dup_lines": (lambda f: f("n_dup_lines") / F.greatest(f("n_lines"), F.lit(1)), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    "repeats": (lambda f: f("n_repeat_words") / F.greatest(f("n_words"), F.lit(1)), (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "long_words": (lambda f: f("word_chars") / F.greatest(f("n_words"), F.lit(1)), (50.0, 30.0, 20.0, 16.0, 14.0, 13.0)),
    "short_words": (lambda f: -f("word_chars") / F.greatest(f("n_words"), F.lit(1)), (-1.0, -1.5, -2.0, -2.5)),
}


def _path() -> list[dict[str, float]]:
    """Cutoff vectors: each step tightens the rule that has gone the smallest part of its way; before its first cutoff a rule is off."""
    at, out = dict.fromkeys(RULES, 0), []
    while any(at[r] < len(RULES[r][1]) for r in RULES):
        r = min((r for r in RULES if at[r] < len(RULES[r][1])), key=lambda r: at[r] / len(RULES[r][1]))
        at[r] += 1
        out.append({q: RULES[q][1][at[q] - 1] if at[q] else math.inf for q in RULES})
    return out


STEPS = _path()
_PLACE = 26  # bits of a word's position beside its window's hash
_SPACES = "[ \t\n\x0b\x0c\r]+"


def _repeated(w: Column) -> Column:
    """Words of the array that lie in 3-word windows found twice or more.

    Windows are sorted by hash; if any two neighbours have equal hashes but other words, they're sorted by their words.
    """
    windows = F.sequence(F.lit(0), F.size(w) - 3)
    at = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    top = lambda x: F.shiftrightunsigned(x, _PLACE)
    code = F.transform(windows, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE).bitwiseOR(i.cast("long")))
    equal = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    near = lambda s, same: F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))

    def exact() -> Column:
        named = F.transform(windows, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
        return let(F.sort_array(named), lambda s: covered(F.transform(near(s, lambda x, y: x["t"] == y["t"]), lambda x: x["i"])))

    def of(c: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda j: (top(F.get(c, j - 1)) == top(F.get(c, j))) & ~equal(at(F.get(c, j - 1)), at(F.get(c, j))))
        return F.when(F.size(c) == 0, F.lit(0)).when(clash, exact()).otherwise(covered(F.transform(c, at)))

    found = let(F.sort_array(code), lambda s: let(near(s, lambda x, y: top(x) == top(y)), of))
    return F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) >= 1 << _PLACE, exact()).otherwise(found)


def features(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    long = lambda c, name: c.cast("long").alias(name)
    inner = lambda w: F.struct(
        long(F.size(w), "n_words"),
        long(F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), "word_chars"),
        long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")), "n_symbols"),
        let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))).alias("l"),
        long(_repeated(w), "n_repeat_words"),
    )
    return let(F.filter(F.split(t, _SPACES), lambda x: x != ""), inner)


def _failed(f: Callable[[str], Column]) -> Column:
    return (f("n_words") < LEAST_WORDS) | (100 * f("n_repeat_words") > MOST_REPEATED * f("n_words"))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("\x00"))


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, text_hash, counts, base_failed) of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), _stratum(stratum).alias("stratum"), F.xxhash64(text).alias("text_hash"), features(F.col(text)).alias("f"))
    rows = rows.select("doc_id", "stratum", "text_hash", "f.n_words", "f.word_chars", "f.n_symbols", F.col("f.l.n_lines").alias("n_lines"), F.col("f.l.n_dup_lines").alias("n_dup_lines"), "f.n_repeat_words")
    return rows.withColumn("base_failed", _failed(F.col))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), summed exactly in logarithms; 1 where k exceeds the mean, which decides nothing."""
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.lit(math.log(p / (1 - p)))
        return F.struct(term.alias("term"), add(acc["sum"], term).alias("sum"))

    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(F.exp(total))


def _step(f: Callable[[str], Column]) -> Column:
    """The first step (from 0) whose verdict rejects; their number if none does."""
    passed = lambda r: F.size(F.filter(F.array(*[F.lit(v[r]) for v in STEPS]), lambda c: RULES[r][0](f) <= c))
    return F.least(*map(passed, RULES))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, step) of strata with a certified step, from measured rows and labels (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    seen = rows.where("not base_failed").select("doc_id", "stratum", "text_hash", _step(F.col).alias("step")).join(known, "doc_id")
    # a doc_id is one trial, and so is a text
    one = seen.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum", "step", "good")).alias("x")).select("x.*")
    one = one.groupBy("stratum", "text_hash").agg(F.min("step").alias("step"), F.min("good").alias("good"))
    counts = written(one.groupBy("stratum", "step").agg(*[F.sum((F.col("good") == g).cast("long")).alias(n) for g, n in ((1, "good"), (0, "bad"))]), "steps")
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    strata = totals.agg(F.count("*").alias("m"))
    tests = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(STEPS) - 1))).alias("step")).join(counts, ["stratum", "step"], "left").fillna(0, ["good", "bad"])
    so_far = Window.partitionBy("stratum").orderBy("step")  # a row a step
    tests = tests.withColumns({"k_good": F.sum("good").over(so_far), "k_bad": F.sum("bad").over(so_far)})
    tests = tests.withColumn("worst", F.max(binomial_tail(F.col("k_good"), F.col("n_good"), risk)).over(so_far)).join(F.broadcast(strata))  # one row
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - F.col("k_good") / F.greatest("n_good", F.lit(1))
    certified = tests.where((F.col("worst") <= F.lit(error) / F.col("m")) & (gain > 0))
    return certified.groupBy("stratum").agg(F.max_by("step", F.struct(gain.alias("gain"), (-F.col("step")).alias("s"))).alias("cut_step"))


def _kept(f: Callable[[str], Column]) -> Column:
    return ~_failed(f) & (_step(f) > F.coalesce("cut_step", F.lit(-1)))


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Measured rows with ``kept``."""
    return rows.join(cuts, "stratum", "left").withColumn("kept", _kept(F.col))


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Only labelled rows are measured for the cutoffs, and texts aren't shuffled."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(f"`{stratum}`").alias("lang"))
    ids = written(labels.where("quality is not null and doc_id is not null").select("doc_id").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # beyond that the texts are shuffled once
    cuts = written(cutoffs(written(measured(own.join(ids, "doc_id", "left_semi")), "labelled"), labels), "cutoffs")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), _stratum(stratum).alias("stratum")).join(cuts, "stratum", "left")
    # an array of one or none: a filter would be pushed down and its features computed a second time
    part = lambda f: lambda c: f["l"][c] if c in ("n_lines", "n_dup_lines") else f[c]
    passed = F.filter(F.array(features(F.col(f"_row.`{text}`"))), lambda f: _kept(part(f)))
    return rows.select("_row", F.explode(passed)).select("_row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(measured(table(spark, sf_dir, "documents")), "measured")
    out = judged(rows, written(cutoffs(rows, table(spark, sf_dir, "labels")), "cutoffs"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
