"""Benchmark decontamination by an FM-index per training shard (operator 4).

A shard is a run of documents of about ``SHARD_BYTES`` inside one Arrow batch. Its words become numbers: words of the
benchmark have their own, all others separate. Runs of benchmark words at least as long as the shortest window make up
the indexed sequence (no window can lie elsewhere, so nothing is lost). All windows are searched at once, backward, by
ranks in a wavelet matrix; occurrences are located by sampled suffix positions, and their spans merged.
Words are told apart by 64-bit hashes.

The benchmark is cut into parts of about ``PASS_BYTES``, each broadcast by itself. Documents are read once: a task holds
one part's windows at a time, searches a batch of documents with it, lets it go and takes the next, in one way for one
part and for many. So memory doesn't grow with the benchmark, and time does.

Nulls and empty texts have no words: no hits. A null item id counts as the id ''. Rows with the same item id are one
item, even in different parts. Repeated documents are scanned one by one. A very long text is a shard of its own. Extra
columns are ignored, or stay where documents are returned, whatever their names. An empty benchmark hits nothing; empty
documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import FmIndex
from .shared import table
from .textblock import PUNCT, U64, blocks, column, per_document, word_hashes, words

WINDOW = 10
#: Text bytes of the benchmark in one part; its windows take some 20 times as much while they are made.
PASS_BYTES = 4 << 20
SHARD_BYTES = 4 << 20

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"
_REPORT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


class Windows:
    """The distinct windows of items, by length, as rows of word numbers (2 and up) with the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.names)}
        item = np.array([place[i] for i, _ in items], np.int64)
        hashes, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, _, data, off in blocks(pa.array([t for _, t in items], pa.large_string())):
            start, end, first = words(data, off, PUNCT)
            hashes.append(word_hashes(data, start, end))
            sizes.append(np.diff(first))
        every, size = np.concatenate(hashes), np.concatenate(sizes)
        self.vocabulary, number = np.unique(every, return_inverse=True)
        number = (number + 2).astype(np.int32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        #: length -> (windows as rows, first item of each window, items)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, int(k)) for k in np.unique(size) if k}):
            rows = np.flatnonzero(size >= window) if n == window else np.flatnonzero(size == n)
            count = size[rows] - n + 1
            at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            windows = np.lib.stride_tricks.sliding_window_view(number, n)[at]
            keys, which = np.unique(np.ascontiguousarray(windows).view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
            pair = np.unique(which.astype(np.int64) * len(self.names) + np.repeat(item[rows], count))
            owner, own = pair // len(self.names), pair % len(self.names)
            self.by_length[n] = (keys.view(np.int32).reshape(-1, n).astype(np.int64), np.searchsorted(owner, np.arange(len(keys) + 1)), own)
        self.shortest = min(self.by_length, default=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 1 for words that no item has."""
        if not len(self.vocabulary) or not len(hashes):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def scan(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in a window's occurrence; (document, item) pairs that occur."""
        n, hit = len(hashes), np.zeros(len(hashes) + 1, np.int64)
        none = np.zeros(0, np.int64)
        if not n or not self.shortest:
            return hit[:n] > 0, none, none
        number = self.numbers(hashes)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known = number > 1
        begin = known.copy()
        begin[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
        stop = known.copy()
        stop[:-1] &= ~known[1:] | (owner[1:] != owner[:-1])
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = stop - begin >= self.shortest
        begin, stop = begin[long], stop[long]
        if not len(begin):
            return hit[:n] > 0, none, none
        # runs of known words, each followed by a 1; where[k] is the word at position k
        size = stop - begin + 1
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        seq = number[np.minimum(where, n - 1)]
        seq[np.cumsum(size) - 1] = 1
        index = FmIndex(seq, len(self.vocabulary) + 2)
        docs, items = [none], [none]
        for length, (rows, at, owners) in self.by_length.items():
            lo, hi = index.search(rows)
            count = hi - lo
            which = np.repeat(np.arange(len(rows)), count)
            if not len(which):
                continue
            there = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            word = where[index.locate(there)]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + length, -1)
            pair = np.unique(owner[word] * len(rows) + which)
            doc, which = pair // len(rows), pair % len(rows)
            many = at[which + 1] - at[which]
            docs.append(np.repeat(doc, many))
            items.append(owners[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[which], many)])
        return np.cumsum(hit[:n]) > 0, np.concatenate(docs), np.concatenate(items)


def _ranges(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, last word) of every run of flagged words."""
    begin, stop = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    stop[:-1] &= ~flags[1:]
    edge = first[(first > 0) & (first < len(flags))]
    begin[edge] = flags[edge]
    stop[edge - 1] = flags[edge - 1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    return np.searchsorted(first, begin, side="right") - 1, begin, stop


def _found(batch: pa.RecordBatch, text: str, parts) -> Iterator[tuple]:
    """For every shard of a batch: its rows, words, hit words, and the item ids of each document."""
    shards = []
    for lo, hi, data, off in blocks(column(batch, text), SHARD_BYTES):
        start, end, first = words(data, off, PUNCT)
        shards.append((lo, hi, data, off, start, end, first, word_hashes(data, start, end), np.zeros(len(start), bool), {}))
    for part in parts:
        windows: Windows = part.value
        for *_, first, hashes, hit, names in shards:
            own, docs, items = windows.scan(hashes, first)
            hit |= own
            for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                names.setdefault(d, set()).add(windows.names[i])
        if len(parts) > 1:  # read again from the worker's disk when it's needed
            del windows
            part.__dict__.pop("_value", None)
    for lo, hi, data, off, start, end, first, _, hit, names in shards:
        yield batch.slice(lo, hi - lo), data, off, start, end, first, hit, names


def _reported(batches: Iterator[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
    """``REPORT`` of rows (doc_id, text)."""
    for batch in batches:
        for rows, data, off, start, end, first, hit, names in _found(batch, "text", parts):
            doc, a, b = _ranges(hit, first)
            cont = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            base = cont[off[:-1]]
            spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for d, x, y in zip(doc.tolist(), start[a].tolist(), end[b].tolist(), strict=True):
                spans[d].append({"start": int(cont[x] - base[d]), "end": int(cont[y] - base[d])})
            n_hit = per_document(hit, first)
            found = [sorted(names.get(d, ())) for d in range(rows.num_rows)]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), np.diff(first), n_hit, pa.array([len(x) for x in found], pa.int64()), pa.array(digest), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                _REPORT,
            )


def _cleaned(batches: Iterator[pa.RecordBatch], text: str, parts) -> Iterator[pa.RecordBatch]:
    """Rows with the hit words, and what is between neighbours of them, cut out of their texts."""
    for batch in batches:
        for rows, data, off, start, end, first, hit, _ in _found(batch, text, parts):
            doc, a, b = _ranges(hit, first)
            where: dict[int, list[tuple[int, int]]] = {}
            for d, x, y in zip(doc.tolist(), start[a].tolist(), end[b].tolist(), strict=True):
                where.setdefault(d, []).append((x, y))
            if where:
                at = rows.schema.get_field_index(text)
                new = rows.column(at).to_pylist()
                for d, cuts in where.items():
                    pieces, done = [], int(off[d])
                    for x, y in cuts:
                        pieces.append(data[done:x].tobytes())
                        done = y
                    new[d] = b"".join([*pieces, data[done : off[d + 1]].tobytes()]).decode()
                columns = [*rows.columns]
                columns[at] = pa.array(new, rows.schema.field(at).type)
                rows = pa.RecordBatch.from_arrays(columns, rows.schema.names)
            yield rows


def _parts(benchmark: DataFrame, window: int) -> list:
    """A broadcast of the windows of each part of the benchmark."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    n = 1 + (items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0) // PASS_BYTES
    context = benchmark.sparkSession.sparkContext
    some = lambda k: [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]  # noqa: E731 -- about PASS_BYTES
    return [context.broadcast(Windows(some(k), window)) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """A row per document: words, hit words, items found, and the merged spans (code points) to remove."""
    parts = _parts(benchmark, window)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_reported, parts=parts), REPORT)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the spans cut out of the texts; other columns stay, clean texts stay as they are."""
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't be mapped
    clean = partial(_cleaned, text=f"c{docs.columns.index(text)}", parts=_parts(benchmark, window))
    return numbered.mapInArrow(clean, numbered.schema).toDF(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
