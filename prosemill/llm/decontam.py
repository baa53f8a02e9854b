"""Benchmark decontamination by a prefix-filtered join with exact verification.

Items are cut into windows of ``width`` consecutive words (an item of fewer
words is one window). A window is contained in a document only if all its
five-word shingles are, so its rarest shingle alone is a sufficient prefix:
documents are counted for every item shingle, shingles are ordered by that
count, and each window is indexed under its rarest one. A scan of the documents
looks up their shingles, bounds each candidate by position and length, and
compares the words themselves over the item-sized window.

Scale: the documents are scanned twice (count, join) without a shuffle of text
or words; only one count per item shingle and task is shuffled. Items go to the
driver and the executors in blocks of at most ``BLOCK_BYTES`` of text, one at a
time and as arrays (about 40 bytes per byte of text while a block is made), with
a scan stage for each block, so both are bounded at any benchmark size.

Defined results: null or empty texts have no words and no hit; a null or empty
item has no window; repeated documents give repeated rows and a null document id
stays; an item id that occurs twice counts once; items without an id are windows
like any others, count together as one item and have no name in the hash; the
order of words, not the order of rows, decides; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

BLOCK_BYTES = 8 << 20
SHINGLE = 5
_BITS = 20


def _lowered_words(t: T.Texts) -> tuple[np.ndarray, T.Words, np.ndarray]:
    data = T.LOWER[t.data]
    w = T.words(t, T.ALNUM, data)
    return data, w, T.SpanHash(data)(w.start, w.end)


class _Lookup:
    """Sorted 64-bit keys behind a bitmap of their high bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``h`` of present keys, and which key each is."""
        maybe = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]


class ItemBlock:
    """The different windows of one block of items; ``order`` turns it into a prefix index.

    All of it is arrays: a window is a first word and a length in the block's own
    words, its items a range of one list.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.names = [item for item, _ in items]
        data, w, self.hash = _lowered_words(T.texts(pa.array([text for _, text in items], pa.string())))
        self.raw, self.start, self.end = data.tobytes(), w.start, w.end
        n = np.diff(w.bounds)
        size = np.minimum(n, width)
        count = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), count)
        first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + w.bounds[:-1][owner]
        length = size[owner]
        key = np.zeros((len(first), width + 1), np.uint64)
        key[:, 0] = length
        for k in range(width):
            inside = k < length
            key[inside, k + 1] = self.hash[first[inside] + k]
        _, at, place = np.unique(key.view([("", np.uint64)] * (width + 1)).ravel(), return_index=True, return_inverse=True)
        self.first, self.lengths = first[at], length[at]
        pairs = np.unique(place.astype(np.int64) * max(len(items), 1) + owner)
        self.items = pairs % max(len(items), 1)
        self.item_bounds = np.searchsorted(pairs // max(len(items), 1), np.arange(len(at) + 1))
        #: For each shingle size the windows use: lookup of shingle hashes; (window, offset, key) triples.
        self.shingles: dict[int, tuple[_Lookup, np.ndarray]] = {}
        short = np.minimum(self.lengths, SHINGLE)
        for size in np.unique(short).tolist():
            win = np.flatnonzero(short == size)
            many = self.lengths[win] - size + 1
            window = np.repeat(win, many)
            offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            keys = T.grams(self.hash, size)[self.first[window] + offset]
            lookup = _Lookup(keys)
            self.shingles[size] = lookup, np.stack((window, offset, np.searchsorted(lookup.keys, keys)), 1)

    def items_of(self, windows: np.ndarray) -> list[str | None]:
        """Ids of the items that have any of these windows; a null id, whosever, is one at the end."""
        found = {self.names[i] for k in windows.tolist() for i in self.items[self.item_bounds[k] : self.item_bounds[k + 1]].tolist()}
        return sorted(found, key=lambda x: (x is None, x or ""))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Keep, for each window, only its rarest shingle; drop windows with a shingle that no document has."""
        self.prefix: dict[int, tuple[_Lookup, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (lookup, triples) in self.shingles.items():
            df = counts.get(size, np.zeros(len(lookup.keys), np.int64))
            rank = np.lexsort((triples[:, 1], df[triples[:, 2]], triples[:, 0]))
            first = np.concatenate(([True], triples[rank][1:, 0] != triples[rank][:-1, 0]))
            best = triples[rank][first]
            best = best[df[best[:, 2]] > 0]
            best = best[np.argsort(best[:, 2], kind="stable")]
            keys = lookup.keys[best[:, 2]]
            own = _Lookup(keys)
            self.prefix[size] = own, best, np.searchsorted(keys, own.keys), np.searchsorted(keys, own.keys, "right")
        del self.shingles

    def count(self, t: T.Texts) -> list[tuple[int, np.ndarray]]:
        """For each shingle size: the number of documents of ``t`` with each key."""
        _, w, h = _lowered_words(t)
        rows, out = w.row(), []
        for size, (lookup, _) in self.shingles.items():
            starts = T.window_starts(w.bounds, size)
            at, key = lookup(T.grams(h, size)[starts]) if len(starts) else (starts, starts)
            pairs = np.unique(rows[starts[at]] * len(lookup.keys) + key)
            out.append((size, np.bincount(pairs % max(len(lookup.keys), 1), minlength=len(lookup.keys))))
        return out

    def match(self, t: T.Texts) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words of ``t``; then row, window and first word of each occurrence."""
        data, w, h = _lowered_words(t)
        rows = w.row()
        found: list[np.ndarray] = []
        for size, (lookup, best, low, high) in self.prefix.items():
            starts = T.window_starts(w.bounds, size)
            if not len(starts) or not len(best):
                continue
            at, key = lookup(T.grams(h, size)[starts])
            n = high[key] - low[key]
            position = np.repeat(starts[at], n)
            entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[key], n)
            window, offset = best[entry, 0], best[entry, 1]
            begin, length = position - offset, self.lengths[window]
            row = rows[position]
            fits = (begin >= w.bounds[row]) & (begin + length <= w.bounds[row + 1])  # positional and length bounds
            begin, window, row, length = begin[fits], window[fits], row[fits], length[fits]
            same = np.ones(len(begin), bool)
            for k in range(int(length.max()) if len(length) else 0):
                inside = k < length
                same &= ~inside | (h[np.where(inside, begin + k, 0)] == self.hash[np.where(inside, self.first[window] + k, 0)])
            found.append(np.stack([row[same], window[same], begin[same]], 1))
        hits = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        raw = data.tobytes() if len(hits) else b""
        words = {win: [self.raw[a:e] for a, e in zip(self.start[f : f + n].tolist(), self.end[f : f + n].tolist(), strict=True)] for win in np.unique(hits[:, 1]).tolist() for f, n in [(self.first[win], self.lengths[win])]}
        exact = [all(raw[w.start[b + k] : w.end[b + k]] == x for k, x in enumerate(words[win])) for _, win, b in hits.tolist()]
        hits = hits[np.array(exact, bool)]
        return w, hits[:, 0], hits[:, 1], hits[:, 2]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[ItemBlock]:
    """Blocks of items of at most about ``BLOCK_BYTES`` of text each, one at a time; always one at least."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(n):
        yield ItemBlock([(r.item, r.text) for r in items.filter(F.expr(f"pmod(xxhash64(item, text), {n}) = {b}")).sort("item", "text").toLocalIterator()], width)


def _indexed(texts: DataFrame, block: ItemBlock) -> Broadcast:
    """Count the block's shingles over all documents, order them by rarity and send the prefix index out."""
    context = texts.sparkSession.sparkContext
    held = context.broadcast(block)

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in T.chunks(batches, "__text"):
            for size, c in held.value.count(T.texts(b.column("__text"))):
                total[size] = total.get(size, 0) + c
        for size, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int64)), pa.array(at), pa.array(c[at].astype(np.int64))], names=["size", "key", "n"])

    counted = texts.mapInArrow(count, "size bigint, key bigint, n bigint").groupBy("size", "key").agg(F.sum("n").alias("n")).toArrow()  # one row per shingle of the block
    held.destroy()
    size, key, n = (counted.column(c).to_numpy() for c in ("size", "key", "n"))
    counts = {k: np.zeros(len(lookup.keys), np.int64) for k, (lookup, _) in block.shingles.items()}
    for k, own in counts.items():
        own[key[size == k]] = n[size == k]
    block.order(counts)
    return context.broadcast(block)


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit`` (words inside occurrences), ``items`` (sorted ids) and ``spans`` (merged word ranges)."""
    T.prepare(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.expr("cast(null as array<string>)").alias("items"), F.expr("cast(null as array<struct<first:bigint,end:bigint>>)").alias("spans"), F.lit(0).cast("bigint").alias("n_words"))
    schema, texts = out.schema, out.select("__text")
    for block in item_blocks(benchmark, item_col, item_text_col, width):
        indexed = _indexed(texts, block)

        def join(batches, indexed=indexed):
            index = indexed.value
            for b in T.chunks(batches, "__text"):
                w, row, window, begin = index.match(T.texts(b.column("__text")))
                items, spans = b.column("items").to_pylist(), b.column("spans").to_pylist()
                for r in np.unique(row).tolist():
                    mine = row == r
                    items[r] = sorted({*(items[r] or ()), *index.items_of(np.unique(window[mine]))}, key=lambda x: (x is None, x or ""))
                    ranges = [(x["first"], x["end"]) for x in spans[r] or ()] + [(a - w.bounds[r], a - w.bounds[r] + n) for a, n in zip(begin[mine].tolist(), index.lengths[window[mine]].tolist(), strict=True)]
                    merged: list[list[int]] = []
                    for a, e in sorted(ranges):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([a, e])
                    spans[r] = [{"first": int(a), "end": int(e)} for a, e in merged]
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__text"), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN)), pa.array(np.diff(w.bounds))], names=[x.name for x in schema])

        out = out.mapInArrow(join, schema)
    return out.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.end - x.first), 0L)").alias("n_hit"),
        F.expr("coalesce(items, cast(array() as array<string>))").alias("items"),
        F.expr("coalesce(spans, cast(array() as array<struct<first:bigint,end:bigint>>))").alias("spans"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The digest of ``find_contamination``: counts, the hash of the item ids, and the verdict."""
    found = find_contamination(docs, benchmark, **columns)
    name = found.columns[0]
    return found.select(
        name,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, with the same columns."""
    T.prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("__text"))
    for block in item_blocks(benchmark, item_col, item_text_col, width):
        indexed = _indexed(texts, block)

        def clean(batches, indexed=indexed):
            for b in T.chunks(batches, text_col):
                _, row, _, _ = indexed.value.match(T.texts(b.column(text_col)))
                keep = np.ones(b.num_rows, bool)
                keep[row] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
