"""Language-model scoring by context-tree weighting over bytes (operator 5).

A text is its UTF-8 bytes, A-Z as a-z, and one end symbol; a byte is eight binary decisions, so there are 255 decision
nodes, each with a context tree of its own: the last byte, the last two, up to ``DEPTH``; before a text stand end
symbols. In every tree node the Krichevsky-Trofimov estimate of its counts and the product of its children's
weighted probabilities are mixed half and half. A score is what the tree of the training texts predicts, without
learning on from the scored text: down the path, each depth's estimate counts with the posterior weight of its node.

Training counts are gathered from all training texts as counts of byte strings (context and next byte), of every length of
text. Strings of texts that are only scored come along with count 0, so each string that a score needs has its
probability computed, where its context is found, and no score falls back on anything.

- All strings whose context ends with the same two bytes are one subtree and one group, at most 2 ** 24 of them; in it
  the deeper depths are weighted. The two upper depths have at most 256 * 255 nodes in sum and are weighted on the driver.
- String probabilities reach the scoring tasks in blocks of about ``BLOCK`` rows, one broadcast each, with a pass over
  the texts for each block, which looks up its own keys only; a row's partial sums are added up by doc_id and text
  hash. Distinct strings level off, and so do passes.
- The ``BLOCK`` most frequent words are looked up in the first pass. Words of a text that aren't among them, a few in a
  hundred, are joined with the other counts by a shuffle. So memory is bounded, and passes don't grow with distinct words.

Base score: add-one unigrams of words and text ends, of the same training texts.

Nulls are empty texts; an empty text has one token and one symbol, its end. A null doc_id counts as training. Repeated
rows are counted and scored as often. Very long texts are cut into pieces that overlap by a context, with equal sums. Ties
don't arise. Extra columns are ignored. Without training texts every bit has probability 1/2. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, table, written
from .textblock import LOWER, SPACE, U64, blocks, column, distinct, mix, word_hashes, words

DEPTH = 4
END = 255  # no byte of UTF-8
#: Rows of a broadcast block, 16 bytes each, for strings and for words; a single block may have twice as many.
BLOCK = 1_500_000
#: Distinct keys that a counting task holds before it hands them on.
_HELD = 3_000_000
GRAM, WORD = 0, 1
#: The key of the end token among the word hashes.
END_WORD = int(mix(np.array([0xE0D], U64)).view(np.int64)[0])
_HALF = np.log(0.5)


# ---- texts as keys ----


def strings(data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols with their contexts, the last byte uppermost and the symbol lowest, and the document of each."""
    docs, size = len(off) - 1, np.diff(off)
    x = np.full(len(data) + docs * (depth + 1), END, np.uint8)
    owner = np.repeat(np.arange(docs), size)
    x[np.arange(len(data)) + owner * (depth + 1) + depth] = LOWER[data]
    real = np.ones(len(x), bool)
    start = off[:-1] + np.arange(docs) * (depth + 1)
    for k in range(depth):
        real[start + k] = False
    key = x[depth:].astype(np.int64)
    for d in range(1, depth + 1):
        key |= x[depth - d : len(x) - d].astype(np.int64) << np.int64(8 * (depth - d + 1))
    return key[real[depth:]], np.repeat(np.arange(docs), size + 1)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words, and each document's first one; ends are left to the caller."""
    start, end, first = words(data, off, SPACE)
    return word_hashes(data, start, end).view(np.int64), first


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted values."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*held))
    by = np.argsort(keys, kind="stable")
    first = _runs(keys[by])
    return keys[by][first], np.add.reduceat(n[by], first) if len(first) else n


def _times(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their numbers; by a sort, which is much faster than an inverse of ``np.unique``."""
    keys = np.sort(keys)
    first = _runs(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) of rows (text, held_out): training counts; strings that only held-out texts have count 0."""
    held: dict[int, list] = {GRAM: [], WORD: []}

    def out(kind: int) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            keys, n = _merged(held[kind])
            held[kind] = []
            for lo in range(0, len(keys), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), keys[part], n[part]], ["kind", "key", "n"])

    def add(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        held[kind].append((keys, n))
        if sum(len(k) for k, _ in held[kind]) > _HELD:
            held[kind] = [_merged(held[kind])]
            if len(held[kind][0][0]) > _HELD // 2:
                yield from out(kind)

    for batch in batches:
        texts, away = column(batch, "text"), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, off in blocks(texts):
            train = ~away[lo:hi]
            key, doc = strings(data, off, depth)
            yield from add(GRAM, *_times(key[train[doc]]))
            only = distinct(key[~train[doc]])
            yield from add(GRAM, only, np.zeros(len(only), np.int64))
            word, first = tokens(data, off)
            word = word[np.repeat(train, np.diff(first))]
            keys, n = _times(word)
            if train.any():
                keys, n = np.append(keys, END_WORD), np.append(n, train.sum())
            yield from add(WORD, keys, n)
    for kind in held:
        yield from out(kind)


# ---- weighting ----


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive values, by Stirling's series nine places up."""
    shift = np.zeros_like(x)
    for k in range(9):
        shift += np.log(x + k)
    z = x + 9
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z - shift


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of the counts."""
    return np.where(n0 + n1 > 0, log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1), 0.0)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the posterior weight of the node's own estimate."""
    both = _HALF + np.logaddexp(own, below)
    return both, np.exp(_HALF + own - both)


def bits(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision nodes (1 to 255) and bits of symbols, eight columns each."""
    level = np.arange(8)
    return (1 << level) | (symbol[:, None] >> (8 - level)), (symbol[:, None] >> (7 - level)) & 1


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all strings of one context of ``top`` bytes: each one's eight probabilities from that depth on; and that
    depth's (nodes, n0, n1, log weighted probability). ``keys`` are sorted."""
    node, bit = bits(keys & 255)
    level = []
    for d in range(depth, top - 1, -1):
        context = keys >> (8 * (depth - d + 1))
        new = np.concatenate([[True], context[1:] != context[:-1]])
        place = ((np.cumsum(new) - 1)[:, None] << 8 | node).ravel()
        at, which = np.unique(place, return_inverse=True)
        ones = np.repeat(counts, 8) * bit.ravel()
        n1 = np.bincount(which, ones, len(at))
        n0 = np.bincount(which, np.repeat(counts, 8), len(at)) - n1
        own = estimate(n0, n1)
        if d == depth:
            total, share = own, np.ones(len(at))
        else:
            below = np.bincount(which[child_first], child_total, len(at))
            total, share = weighted(own, below)
        # a child is added once to its parent: by the first of its strings
        child_total = total
        child_first = np.zeros(len(at), np.int64)
        child_first[which[::-1]] = np.arange(len(which))[::-1]
        level.append((which, (np.where(bit.ravel() == 1, n1[which], n0[which]) + 0.5) / (n0 + n1 + 1)[which], share[which], at, n0, n1, total))
    chance = level[0][1]
    for _, own, share, *_ in level[1:]:
        chance = share * own + (1 - share) * chance
    _, _, _, at, n0, n1, total = level[-1]
    return chance.reshape(-1, 8), at & 255, n0, n1, total


def upper(context: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From sums over the subtrees by last byte and node: a and b, 256 x 256, with probability of a bit 1 = a + b * that
    of the subtree; a bit 0 likewise, with a of the other bit: its first axis."""
    square = np.zeros((3, 256, 256))
    for k, v in enumerate((n0, n1, total)):
        square[k][context, node] = v
    zero, one, below = square
    w1, share1 = weighted(estimate(zero, one), below)
    z0, o0 = zero.sum(0), one.sum(0)
    # an unused node's probability is 1
    _, share0 = weighted(estimate(z0, o0), w1.sum(0))
    rest = (1 - share0) * (1 - share1)
    kt = lambda n, z, o: (n + 0.5) / (z + o + 1)
    a = np.stack([share0 * kt(n, z0, o0) + (1 - share0) * share1 * kt(m, zero, one) for n, m in ((z0, zero), (o0, one))])
    return a, rest


def _trees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, chances) of strings and (-1 - (context << 8 | node), n0, n1, total) of subtrees, from sorted (key, n)."""
    shift = 8 * (depth - 1)

    def done(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        chance, node, n0, n1, total = subtree(keys, counts, depth)
        names = ["key", "chances", "n0", "n1", "total"]
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), len(keys), [None, pa.py_buffer(np.ascontiguousarray(chance).tobytes())])
        for lo in range(0, len(keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            k = pa.array(keys[part])
            yield pa.RecordBatch.from_arrays([k, flat[part].cast(pa.binary()), *[pa.nulls(len(k), pa.float64())] * 3], names)
        of = -1 - ((int(keys[0]) >> shift << 8) | node)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.nulls(len(of), pa.binary()), n0, n1, total], names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        cuts = [0, *(np.flatnonzero(np.diff(keys >> shift)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1][0][-1] >> shift != keys[lo] >> shift:
                yield from done(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((keys[lo:hi], n[lo:hi]))
    if held:
        yield from done(*(np.concatenate(x) for x in zip(*held)))


def _priced(batches: Iterator[pa.RecordBatch], top, depth: int) -> Iterator[pa.RecordBatch]:
    """(key, value): log10 of each string's probability."""
    a, rest = top.value
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        chance = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, 8)
        node, bit = bits(keys & 255)
        last = (keys >> (8 * depth))[:, None]
        p = a[bit, last, node] + rest[last, node] * chance
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(p).sum(axis=1))], ["key", "value"])


def model(docs: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int, int]:
    """(key, value) of strings and of training words, training tokens, distinct ones; ``docs``: (text, held_out)."""
    counted = docs.select("text", "held_out").mapInArrow(lambda it: _counted(it, depth), "kind int, key long, n long")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counts.where(f"kind = {WORD}").select("key", F.col("n").cast("double").alias("value"))
    seen = vocabulary.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count("*")).first()
    grams = counts.where(f"kind = {GRAM}").select("key", "n")
    grouped = grams.repartition(F.shiftright("key", 8 * (depth - 1))).sortWithinPartitions("key")  # at most 2 ** 24 strings a group
    trees = written(grouped.mapInArrow(lambda it: _trees(it, depth), "key long, chances binary, n0 double, n1 double, total double"), "trees")
    sums = trees.where("key < 0").groupBy(F.expr("(-1 - key) >> 16").alias("context"), F.expr("(-1 - key) & 255").alias("node")).agg(F.sum("n0"), F.sum("n1"), F.sum("total"))
    above = sums.toArrow()  # at most 256 * 255 rows
    top = docs.sparkSession.sparkContext.broadcast(upper(*(above.column(k).to_numpy() for k in range(5))))
    priced = trees.where("key >= 0").select("key", "chances").mapInArrow(lambda it: _priced(it, top, depth), "key long, value double")
    return written(priced, "strings"), written(vocabulary, "words"), int(seen[0]), seen[1]


# ---- scoring ----


def _found(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of keys, 0 where the table has none; which it has."""
    own, values = table_
    if not len(own):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    there = own[at] == keys
    return np.where(there, values[at], 0.0), there


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The block of a key, as ``_PART`` has it."""
    return (keys ^ (keys >> np.int64(17)) ^ (keys >> np.int64(31))) % parts


_PART = "pmod(key ^ shiftright(key, 17) ^ shiftright(key, 31), {parts})"


def _word_sums(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """By owner, the sums of log10(count + 1) over the words that the table has, how many these are, and the other words."""
    by = np.argsort(keys)
    keys, owner = keys[by], owner[by]
    values, there = _found(table_, keys)  # sorted queries stay in the cache
    other, whose = keys[~there], owner[~there]
    first = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=rows))])
    others = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(other[np.argsort(whose, kind="stable")]))
    return np.bincount(owner, np.log10(values + 1), rows).astype(np.float64), np.bincount(owner, there, rows).astype(np.int64), others


def _string_sums(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray, owner: np.ndarray, rows: int, k: int, parts: int, depth: int) -> np.ndarray:
    """By owner, the sums of the values of the strings of block ``k``. Key and owner are sorted as one number."""
    bits = 8 * (depth + 1)
    own = np.flatnonzero(_part(keys, parts) == k)
    both = np.sort(keys[own].view(U64) << U64(64 - bits) | owner[own].astype(U64))
    keys, owner = (both >> U64(64 - bits)).view(np.int64), (both & U64((1 << (64 - bits)) - 1)).view(np.int64)
    first = _runs(keys)
    values, _ = _found(table_, keys[first])
    return np.bincount(owner, np.repeat(values, np.diff(np.append(first, len(keys)))), rows).astype(np.float64)


def _scored(batches: Iterator[pa.RecordBatch], block, depth: int, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, x, y, n_bytes, n_tokens, n_known, base, score, others): what this block's keys add to each row's sums.

    ``others``: words to be looked up elsewhere. A block without a vocabulary adds nothing for words.
    """
    grams, vocabulary = block.value
    for batch in batches:
        for lo, hi, data, off in blocks(column(batch, "text")):
            key, doc = strings(data, off, depth)
            score = _string_sums(grams, key, doc, hi - lo, k, parts, depth)
            word, first = tokens(data, off)
            own = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(first)), np.arange(hi - lo)])
            word = np.concatenate([word, np.full(hi - lo, END_WORD)])
            if vocabulary is None:
                base, known, others = np.zeros(hi - lo), np.zeros(hi - lo, np.int64), pa.nulls(hi - lo, pa.list_(pa.int64()))
            else:
                base, known, others = _word_sums(vocabulary, word, own, hi - lo)
            # two hashes of the text, for adding up
            ends = np.concatenate([[0], np.cumsum(np.diff(off) + 1)])
            place = (np.arange(len(key)) - ends[doc]).view(U64)
            total = [np.concatenate([[U64(0)], np.cumsum(mix(key.view(U64) * U64(m) + place))]) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            x, y = ((t[ends[1:]] - t[ends[:-1]]).view(np.int64) for t in total)
            rest = [batch.column(c).slice(lo, hi - lo) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(x), pa.array(y), pa.array(np.diff(off)), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(score), others], ["doc_id", "held_out", "x", "y", "n_bytes", "n_tokens", "n_known", "base", "score", "others"])


def _block(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    keys, values = got.column("key").to_numpy(), got.column("value").to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by]


def _frequent(vocabulary: DataFrame) -> float:
    """The least count that at most ``BLOCK`` words reach, all words with it included."""
    times = vocabulary.groupBy("value").agg(F.count("*").alias("n")).toArrow()  # fewer rows than the root of twice the words of all texts
    values, n = times.column("value").to_numpy(), times.column("n").to_numpy()
    by = np.argsort(-values)
    fits = values[by][np.cumsum(n[by]) <= BLOCK]
    return float(fits[-1]) if len(fits) else np.inf


def _with_others(first: DataFrame, rest: DataFrame) -> DataFrame:
    """The sums ``first`` with what their other words add by ``rest`` (key, value), the counts that were not broadcast."""
    found = first.select("row", F.explode("others").alias("key")).join(spread(rest), "key")  # words without a count add nothing
    more = found.groupBy("row").agg(F.count("*").alias("_n_known"), F.sum(F.log10(F.col("value") + 1)).alias("_base"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return first.join(spread(more), "row", "left").select(*[plus(c, f"_{c}") if c in ("n_known", "base") else c for c in first.columns])


def scored(docs: DataFrame, held_out: Column | None = None, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    ``held_out``: by doc_id, rows that aren't learned from. Scores are log10 probabilities; the last is the code length.
    """
    if not 2 <= depth <= 5:  # a string's key and its text's place in a batch are sorted as one 64-bit number
        raise ValueError(f"depth is 2 to 5, not {depth}")
    out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", out.alias("held_out"), "text")
    grams, vocabulary, total, distinct = model(rows, depth)
    parts = 1 + 2 * (grams.count() // (2 * BLOCK))  # odd, so that low bits don't decide alone
    least = _frequent(vocabulary)
    often, rest = vocabulary.where(F.col("value") >= least), vocabulary.where(F.col("value") < least)
    passes = []
    for k in range(parts):
        block = docs.sparkSession.sparkContext.broadcast((_block(grams.where(F.expr(_PART.format(parts=parts)) == k)), None if k else _block(often)))  # about BLOCK rows each
        one = rows.mapInArrow(lambda it, b=block, k=k: _scored(it, b, depth, k, parts), "doc_id long, held_out boolean, x long, y long, n_bytes long, n_tokens long, n_known long, base double, score double, others array<long>")
        passes.append(written(one.drop("others") if k else one.withColumn("row", F.monotonically_increasing_id()), "pass"))
        block.destroy()
    if not rest.isEmpty():
        passes[0] = _with_others(passes[0], rest)
    passes[0] = passes[0].drop("others", "row")
    sums = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "held_out", "x", "y", "n_bytes", "n_tokens").agg(F.count("*").alias("r"), *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    copies = (F.col("r") / parts).cast("long")
    base = F.col("base") / copies - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    score = F.col("score") / copies
    length = -score * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    out = sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") / copies).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), "n_bytes", length.alias("bits_per_byte"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy"))
    return out.drop("_copy")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scored(table(spark, sf_dir, "documents"), held)
