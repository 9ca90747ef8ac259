"""Near-duplicate detection: MinHash signatures joined by a multi-index Hamming join (operator 3).

Each distinct shingle set gets ``VALUES`` MinHash values of ``BITS`` bits. Two sets are candidates if their signatures
differ in at most ``DISTANCE`` values. By the pigeonhole principle, of ``CHUNKS`` chunks at least one then differs in at
most one value (DISTANCE < 2 * CHUNKS), so a signature is indexed once for each chunk and each value of it left out:
all pairs under the distance meet under a key. At a similarity of 0.85 the distance is binomial (64, 0.15), and
exceeds 23 in about one of 100,000 borderline pairs; candidates are confirmed on full sets.

Pairs are not expanded within a key. First, every set is compared with the smallest one under each of its keys (the
hub); links give components. What stays untested are sets of different components under one key. Of these, two can be
similar enough only if they share one of their rarest shingles (of n shingles the n - ceil(0.85 n) + 1 rarest among all
such sets), so only those that do are compared: pages of one template meet under many keys, but not under
what each has for itself. What is left untested otherwise lies inside one component, so the components are those of all
candidate pairs. Links are then counted anew: all sets of a component are compared with each other, in blocks, so none
of its links is missed.

Nulls and texts without words have empty sets and link with nothing. Equal sets are one class, whatever their number.
Links join sets, whatever their doc_ids: different texts under one doc_id are different sets. Rows with the same doc_id
give a row each; the smallest doc_id names the component; a null doc_id is no smaller than any. If several sets of a
component have that doc_id, the rows of one are kept. Components that aren't linked can share a name. A very long text is
one set, an array in one row. Extra columns are ignored or stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import dropped, joined, settled, spread, table, written
from .textblock import SPACE, U64, blocks, column, distinct, mix, word_hashes, words

VALUES, BITS, CHUNKS = 64, 8, 12
DISTANCE = 2 * CHUNKS - 1
THRESHOLD = 85  # per cent of the union
#: The filter that spares texts outside all candidate pairs the shuffle has ``FILTER_LOAD`` bits for each set in a pair, but
#: at most 2 ** FILTER_BITS (32 MB): beyond some 16 million such sets it spares less, and drops none at any size.
FILTER_BITS, FILTER_LOAD = 28, 16
#: About so many sets and shingles of a component are in one block; two blocks are compared in one task.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 500_000
#: Shingles whose membership is compared at once.
BLOCK_COLUMNS = 4096
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 2**63, VALUES, dtype=U64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 2**64, VALUES, dtype=U64)
#: Chunks of values, as index arrays.
_CHUNKS = np.array_split(np.arange(VALUES), CHUNKS)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and each document's first one (length: documents + 1)."""
    start, end, first = words(data, off, SPACE)
    h = word_hashes(data, start, end)
    n = np.diff(first)
    if len(h) >= 3:
        three = mix(h[:-2] * U64(0x9E3779B97F4A7C15) + mix(h[1:-1] * U64(0xC2B2AE3D27D4EB4F) + mix(h[2:] * U64(0x165667B19E3779F9))))
    else:
        three = np.zeros(0, U64)
    count = np.maximum(n - 2, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    values = three[at]
    short = np.flatnonzero((n > 0) & (n < 3))
    if len(short):
        one = h[first[short]]
        two = np.where(n[short] == 2, h[np.minimum(first[short] + 1, len(h) - 1)], U64(0))
        doc = np.concatenate([doc, short])
        values = np.concatenate([values, mix(one * U64(31) + mix(two + n[short].astype(U64)))])
    out, sizes = [], np.zeros(len(n), np.int64)
    cuts = np.searchsorted(doc, np.arange(len(n) + 1)) if not len(short) else None
    if cuts is None:
        by = np.argsort(doc, kind="stable")
        doc, values = doc[by], values[by]
        cuts = np.searchsorted(doc, np.arange(len(n) + 1))
    for d in range(len(n)):
        own = distinct(values[cuts[d] : cuts[d + 1]])
        sizes[d] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``VALUES`` bytes per non-empty set: the low byte of the minimum of each of as many hash functions."""
    full = first[:-1][np.diff(first) > 0]
    out = np.empty((len(full), VALUES), np.uint8)
    for k in range(VALUES):
        low = np.minimum.reduceat(values * _MULTIPLY[k] ^ (values >> U64(29)) * _ADD[k], full)
        out[:, k] = (mix(low) & U64(255)).astype(np.uint8)
    return out


def whole_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two hashes of every whole set and a third one of both, its node id (0 for empty sets)."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), 3), U64)
    if len(some):
        out[some, 0] = np.add.reduceat(mix(values), first[some])
        out[some, 1] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), first[some])
        out[some, 2] = mix(out[some, 0] + mix(out[some, 1] ^ size[some].astype(U64)))
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, key = column(batch, "text"), batch.column(0)
        for lo, hi, data, off in blocks(texts):
            values, first = shingle_sets(data, off)
            size = np.diff(first)
            some = np.flatnonzero(size)
            code = np.zeros((hi - lo, VALUES), np.uint8)
            if len(some):
                code[some] = signatures(values, first)
            whole = whole_hashes(values, first)
            yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo).cast(pa.int64()), size, *whole.T.copy(), pa.array([c.tobytes() for c in code], pa.binary())], ["doc_id", "n", "h1", "h2", "rep", "sig"])


def _hashed(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Rows with _n, _h1, _h2 of their sets."""
    for batch in batches:
        for lo, hi, data, off in blocks(column(batch, text)):
            values, first = shingle_sets(data, off)
            whole = whole_hashes(values, first)
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(np.diff(first)), pa.array(whole[:, 0]), pa.array(whole[:, 1])], [*batch.schema.names, "_n", "_h1", "_h2"])


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U64)) & U64((1 << bits) - 1)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """64-bit words of the id filter, of which each id sets a bit."""
    for batch in batches:
        slot = _slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
        yield pa.RecordBatch.from_arrays([slot >> 6, (U64(1) << (slot & 63).astype(U64)).view(np.int64)], ["word", "bits"])


def _sets(batches: Iterator[pa.RecordBatch], marks) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the documents whose ids pass the filter."""
    bits = np.frombuffer(marks.value, U64)
    wide = len(bits).bit_length() + 5
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = _slots(ids, wide)
        batch = batch.filter(pa.array((bits[slot >> 6] >> (slot & 63).astype(U64) & U64(1)).astype(bool)))
        for _, _, data, off in blocks(column(batch, "text")):
            values, first = shingle_sets(data, off)
            node = whole_hashes(values, first)[:, 2].copy()
            sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), sets], ["rep", "shingles"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys of signatures: chunk and left-out value above 40 bits, the other values (at most five) below."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES).astype(np.int64)
        out = np.empty((len(sig), VALUES), np.int64)
        at = 0
        for c, own in enumerate(_CHUNKS):
            for gap in range(len(own)):
                key = np.zeros(len(sig), np.int64)
                for v in np.delete(own, gap):
                    key = (key << BITS) | sig[:, v]
                key |= (c * 8 + gap) << 40
                out[:, at] = key
                at += 1
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * VALUES, pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], ["rep", "sig", "n", "keys"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs under the signature distance whose sizes allow the similarity."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 3))
        near = (x != y).sum(axis=1) <= DISTANCE
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))


def degrees(values: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many sets each set is linked with: of the other block, or, where all are of one block, of the other sets."""
    size, doc = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    at, doc = (np.cumsum(shared) - 1)[at[shared[at]]], doc[shared[at]]
    by = np.argsort(at, kind="stable")
    at, doc = at[by], doc[by]
    one = own.min() == own.max()
    x = np.arange(len(own)) if one else np.flatnonzero(own == own.min())
    y = x if one else np.flatnonzero(own == own.max())
    both = np.zeros((len(x), len(y)), np.float32)  # whole numbers under 2 ** 24
    for lo in range(0, int(shared.sum()), BLOCK_COLUMNS):
        part = slice(*np.searchsorted(at, [lo, lo + BLOCK_COLUMNS]))
        has = np.zeros((len(own), min(BLOCK_COLUMNS, int(shared.sum()) - lo)), np.float32)
        has[doc[part], at[part] - lo] = 1
        both += has[x] @ has[y].T
    n = both.astype(np.int64)
    linked = n * 100 >= (size[x][:, None] + size[y][None, :] - n) * THRESHOLD
    if one:
        np.fill_diagonal(linked, False)
        return linked.sum(axis=1)
    out = np.zeros(len(own), np.int64)
    out[x], out[y] = linked.sum(axis=1), linked.sum(axis=0)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n) by group, of rows (root, i, j, own, rep, shingles) that stand by group (root, i, j)."""

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        sets, own = t["shingles"].combine_chunks(), t["own"].to_numpy()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))]).astype(np.int64)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        if i != j and own.min() == own.max():  # the other block has no sets
            n = np.zeros(len(own), np.int64)
        else:
            n = degrees(sets.flatten().to_numpy(zero_copy_only=False), first, own)
        return pa.RecordBatch.from_arrays([t["rep"].combine_chunks(), pa.array(n)], ["rep", "n"])

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            here = tuple(k[:, lo])
            if held and here != key:
                yield count(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            key = here
    if held:
        yield count(held)


def _degree(roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n_links) for components (node, root) of at least two sets, from the sets (rep, shingles) of all nodes."""
    sets = sets.join(spread(roots.withColumnRenamed("node", "rep")), "rep")
    parts = sets.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.size("shingles")).alias("s"))
    parts = parts.select("root", F.expr(f"1 + greatest(c div {BLOCK_SETS}, s div {BLOCK_SHINGLES})").alias("parts"))
    rows = sets.join(spread(parts), "root").withColumn("own", F.expr("pmod(xxhash64(rep), parts)"))
    rows = rows.withColumn("k", F.explode(F.expr("sequence(0L, parts - 1)"))).select("root", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "rep", "shingles")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(_counted, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def connected(edges: DataFrame, written=written) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Alternates large-star and small-star steps; each is two shuffles of the edges, and is written before the next.
    Only different edges remain, so a node with many links doesn't collect them in one task.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(low), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old, done, edges = edges, state(new) == state(edges), new
        dropped(old)
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _fetched(ends: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, shingles) of the nodes ``ends`` (rep)."""
    ends = written(ends, "ends")
    bits = min(FILTER_BITS, max(16, (ends.count() * FILTER_LOAD).bit_length()))
    words = sigs.join(spread(ends), "rep", "left_semi").select("class_id").mapInArrow(lambda it: _marks(it, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.int64)  # at most 2 ** (FILTER_BITS - 6) words
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    marks = texts.sparkSession.sparkContext.broadcast(filled.tobytes())
    sets = texts.mapInArrow(lambda it: _sets(it, marks), "rep long, shingles array<long>")  # the filter has no false negatives
    sets = sets.join(spread(ends), "rep", "left_semi").groupBy("rep").agg(F.first("shingles").alias("shingles"))  # of rows with equal texts one
    return written(sets, "sets")


def sharing_rare(sets: DataFrame) -> DataFrame:
    """(a, b) with a < b of different roots, for (rep, root, shingles): pairs that share one of their rarest shingles.

    All pairs of the needed similarity are among them: a prefix filter, by how many of the sets have a shingle.
    """
    tokens = sets.select("rep", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    many = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(spread(many), "s").groupBy("rep", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("t"))  # a set's own shingles
    # a set's shingles that no other has are its rarest
    prefix = F.expr(f"n - cast(ceil(n * {THRESHOLD} / 100) as int) + 1 - (n - size(t))")
    rare = own.select("rep", "root", "n", F.explode(F.slice("t", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("x")).select("rep", "root", "n", "x.s")
    rare = written(rare, "rare")
    left, right = (rare.select("s", F.col("rep").alias(a), F.col("root").alias(f"r{a}"), F.col("n").alias(f"n{a}")) for a in "ab")
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * THRESHOLD
    return left.join(spread(right), "s").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose full sets are similar enough, and the sets. Distances are tested first, on signatures."""
    x = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx"))
    y = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny"))
    near = pairs.join(spread(x), "a").join(spread(y), "b").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * THRESHOLD).select("a", "b", "x", "y")
    near = written(near.mapInArrow(_near, "a long, b long"), "near")
    ends = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
    sets = _fetched(ends, sigs, texts)
    found = near.join(spread(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s"))), "a").join(spread(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t"))), "b")
    both = F.size(F.array_intersect("s", "t"))
    return found.select("a", "b", both.alias("both"), (F.size("s") + F.size("t")).alias("sum")).where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * THRESHOLD).select("a", "b"), sets


def _found(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The columns of ``near_duplicates`` with n, h1 and h2 of every row's set."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(docs.mapInArrow(_sign, "doc_id long, n long, h1 long, h2 long, rep long, sig binary"), "signed")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2", "rep").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.count("*").alias("n_rows")), "classes")
    sigs = classes.select("rep", "class_id", "sig", "n")
    keyed = sigs.select("rep", "sig", "n").mapInArrow(_keys, "rep long, sig binary, n long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("times"))
    hubs = written(hubs.where("top > hub").drop("top"), "hubs")
    # keys of one set alone aren't in hubs; they have one row each
    members = written(joined(keyed, hubs, ["key"], "times").where("hub is not null"), "members")
    texts = docs.withColumnRenamed("doc_id", "rep")
    tested = members.where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links, sets = _confirmed(tested, sigs, texts)
    links = written(links, "links")
    roots = connected(links)
    # sets under keys where several components meet
    of = written(members.join(spread(roots.withColumnRenamed("node", "rep")), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "roots")
    meet = of.groupBy("key").agg((F.min("root") < F.max("root")).alias("meet"), F.count("*").alias("times"))
    left = written(joined(of, written(meet, "meet"), ["key"], "times").where("meet").select("rep", "root").distinct(), "left")
    others = sharing_rare(_fetched(left.select("rep"), sigs, texts).join(spread(left), "rep")).join(spread(tested), ["a", "b"], "left_anti")
    more, further = _confirmed(others, sigs, texts)
    more = written(more, "links")
    if not more.isEmpty():
        links = written(links.unionByName(more), "links")
        roots = connected(links)
    degree = written(_degree(roots, sets.unionByName(further.join(spread(sets), "rep", "left_anti"))), "degrees")
    linked = roots.withColumnRenamed("node", "rep").join(spread(classes.select("rep", "class_id")), "rep")
    names = linked.groupBy("root").agg(F.min(F.struct("class_id", "rep")).alias("first"))
    linked = linked.select("rep", "root").join(spread(names), "root").join(spread(degree), "rep").select("rep", "first", "n_links")
    classes = classes.join(spread(linked), "rep", "left").select("n", "h1", "h2", "n_rows", "class_id", F.coalesce("first.class_id", "class_id").alias("component_id"), F.coalesce(F.col("first.rep") == F.col("rep"), F.lit(True)).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    signed = signed.drop("sig", "rep")
    linked = F.expr("n > 0 and doc_id is not null")
    out = joined(signed.where(linked), written(classes, "found"), ["n", "h1", "h2"], "n_rows").unionByName(signed.where(~linked), allowMissingColumns=True)
    alone = F.expr("component_id is null")
    kept = alone | ((F.col("doc_id") == F.col("component_id")) & F.col("first"))
    own = lambda c, value: F.when(alone, value).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id", F.col("doc_id")), kept.alias("kept"), own("class_id", F.col("doc_id")), own("n_links", F.lit(0)), "n", "h1", "h2")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_links): ``docs`` by component of linked documents.

    ``class_id`` is the smallest doc_id with the same set, ``n_links`` with how many other classes this one is linked.
    """
    return _found(docs, text, key).drop("n", "h1", "h2")


def one_per_component(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per component, own columns only; rows without words or with a null doc_id stay.

    Rows are judged by their sets. Of rows that share a kept doc_id and its set, the first by content stays.
    """
    found = settled(docs.sparkSession, lambda: _found(docs, text, key).where("doc_id is not null"), "found")
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).where("rows > 1 or not kept")
    ids = written(ids, "ids")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    alone = rows.join(spread(ids.select("id")), "id", "left_anti").select("row")
    many = ids.where("rows > 1").select("id")
    sets = found.where("kept").join(spread(many), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    rows = rows.join(spread(many), "id").select("row", "id", "text")
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("_n", "_h1", "_h2"))])
    rows = rows.mapInArrow(lambda it: _hashed(it, "text"), schema).join(spread(sets), ["id", "_n", "_h1", "_h2"], "left_semi")
    # of a kept set's rows the first by content; rows without words all stay
    marked = rows.select("row", "id", "_n", "_h1", "_h2", F.xxhash64("text", F.to_json("row")).alias("at"))
    first = marked.where("_n > 0").groupBy("id", "_n", "_h1", "_h2").agg(F.min_by("row", "at").alias("row")).select("row")
    return alone.unionByName(first).unionByName(marked.where("_n = 0").select("row")).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
