"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its five-word shingles. Equal sets are first joined to
one representative each. For every independent tree, a representative starts at
the root and goes, by the values of one or two minwise coordinates that the node
itself selects, to child nodes; a node of more than ``node_limit`` members (or
more than ``node_shingles`` shingles together) branches again by coordinates of
its own, a small one is compared exhaustively. The expected number of children
that a pair at the threshold shares stays at or over one on every level, and
``trees`` repeats the descent to reach the target recall (of pairs at the
threshold over 0.99 in a group of 12,000 near copies, which takes 17 levels). Nodes also carry a
size class, as sets at the threshold cannot differ more in size.

Small nodes are compared in two steps: by 128 one-byte minwise values with a
margin of about four standard errors, then on the full sets. Only verified links
count. What leaves a node is a spanning forest of its links, never its pairs.
Links become classes by alternating large-star and small-star steps on tables.

Scale: what is shuffled is about a dozen short rows for each distinct set, 128
bytes for members of small nodes that are not alone, and the full sets of the
documents with a likely partner. Nothing of document count goes to the driver;
the one broadcast is a bitmap of at most ``FILTER_BITS`` bits, whose words are
made by partial aggregation (past about that many keys it only stops saving work). Classes of copies
do not meet in one task, and a cluster of over ``GROUP`` near copies is verified as pairs of blocks in as many tasks: counts and minima are pre-aggregated and joins on a hot
set leave its rows free to be split. A node that is still too large after
``max_depth`` levels is finished exactly, on the full sets: members that link to
the node's pivot are one star, and every other member is compared with every
member, block against block. That work is linear in the star and grows with
the product of the other members and all members.

Defined results: a null or empty text has an empty set, is linked with nothing
and is kept; fewer than five words are one shingle; a row with a null id is in no
class (null ``component_id``) and is kept; repeated rows with one id are one
document, each row kept alike; rows with one id and different texts are judged
each by its own text, and a link to either is one to the id; ids are of an
integer type, anything else is an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, MapType, VariantType

from . import textops as T
from .shared import drop, written

COORDINATES = 128
FILTER_BITS = 1 << 27

_seeds = np.random.RandomState(7919)  # noqa: NPY002
_XOR = _seeds.randint(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_MUL = _seeds.randint(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


#: The stage's similarity; the 85 of ``JoinRules`` is that of op10.
STAGE_PERCENT = 80


@dataclass(frozen=True)
class JoinRules:
    #: Links have 100 * intersection >= percent * union.
    percent: int = 85
    shingle: int = 5
    trees: int = 12
    node_limit: int = 2048
    node_shingles: int = 3_000_000
    max_depth: int = 24


def shingle_sets(t: T.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and row bounds."""
    data = T.LOWER[t.data]
    w = T.words(t, T.NONSPACE, data)
    h = T.SpanHash(data)(w.start, w.end)
    count = np.diff(w.bounds)
    starts = T.window_starts(w.bounds, size)
    g = T.grams(h, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    rows = w.row()[starts]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([T.gram_hash(h[w.bounds[r] : w.bounds[r + 1]]) for r in short.tolist()], np.uint64)
        g, rows = np.concatenate((g, whole)), np.concatenate((rows, short))
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    if len(g):
        first = np.concatenate(([True], (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])))
        g, rows = g[first], rows[first]
    return g, np.searchsorted(rows, np.arange(len(t) + 1))


def minwise(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minwise values of every row, uint32 [rows, COORDINATES]; rows of empty sets hold the largest value."""
    out = np.full((len(bounds) - 1, COORDINATES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if len(filled):
        x = (g >> np.uint64(32)).astype(np.uint32)
        v, s = np.empty_like(x), np.empty_like(x)
        for k in range(COORDINATES):
            np.bitwise_xor(x, _XOR[k], out=v)
            np.multiply(v, _MUL[k], out=v)
            np.right_shift(v, np.uint32(15), out=s)
            np.bitwise_xor(v, s, out=v)
            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
            out[filled, k] = np.minimum.reduceat(v, bounds[:-1][filled])
    return out


def _chosen(node: np.ndarray, percent: int = 85) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that nodes select: always one, and a second for so many nodes that a pair at the threshold shares 1.02 children (a fifth at 85)."""
    x = T.mix(node ^ np.uint64(0xA5A5A5A55A5A5A5A))
    first = (x % np.uint64(COORDINATES)).astype(np.int64)
    second = ((x >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
    return first, np.where((x >> np.uint64(40)) % np.uint64(100) < np.uint64(min(-(-10200 // percent) - 100, 100)), second, -1)


def _root_coordinates(trees: int, percent: int = 85) -> list[tuple[int, int]]:
    """(tree, coordinate) of every branch at the roots; all sets of a tree branch there alike."""
    first, second = _chosen(T.mix(np.arange(1, trees + 1, dtype=np.uint64)), percent)
    return [(k, int(c)) for k in range(trees) for c in dict.fromkeys((first[k], second[k])) if c >= 0]


def _children(node: np.ndarray, values: np.ndarray, percent: int = 85) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of members with the given one-byte minwise values: member index and child key."""
    first, second = _chosen(node, percent)
    at = np.arange(len(node))
    own, keys = [], []
    for c in (first, np.where(second == first, -1, second)):
        has = at[c >= 0]
        own.append(has)
        keys.append(T.mix(node[has] * np.uint64(0x9E3779B97F4A7C15) + T.mix(values[has, c[has]].astype(np.uint64) + (c[has].astype(np.uint64) << np.uint64(40)))))
    return np.concatenate(own), np.concatenate(keys)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blobs(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.shape[1]), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())


def _digested(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """id, n (set size), digest of the set, its minwise values at the roots' coordinates, and one byte of all of them."""
    at_roots = [c for _, c in _root_coordinates(rules.trees, rules.percent)]

    def run(batches):
        for b in T.chunks(batches, "text"):
            g, bounds = shingle_sets(T.texts(b.column("text")), rules.shingle)
            n = np.diff(bounds)
            raw = g.tobytes()
            digests = [hashlib.blake2b(raw[8 * a : 8 * e], digest_size=16).digest() if e > a else None for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            minima = minwise(g, bounds)
            short = (minima & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(digests, pa.binary()), _blobs(np.ascontiguousarray(minima[:, at_roots]).view(np.uint8).reshape(len(n), -1)), _blobs(short)], names=["id", "n", "digest", "roots", "short"])

    return docs.mapInArrow(run, "id bigint, n bigint, digest binary, roots binary, short binary")


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The values of a binary column of one width, as an array of rows."""
    return np.frombuffer(T.texts(column).data.tobytes(), kind).reshape(len(column), width)


def _roots(reps: DataFrame, rules: JoinRules) -> DataFrame:
    """First-level nodes of all trees.

    Size classes are octaves; a set close enough to the next one to have partners there belongs to it too.
    """
    branches = _root_coordinates(rules.trees, rules.percent)

    def run(batches):
        for b in batches:
            values = _rows(b.column("roots"), np.uint32, len(branches)).astype(np.uint64)
            n = b.column("n").to_numpy()
            octave = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            near = np.flatnonzero(100 * n >= rules.percent * (np.int64(2) << octave))
            member = np.concatenate((np.arange(len(n)), near))
            size = np.concatenate((octave, octave[near] + 1)).astype(np.uint64)
            rep, count = b.column("rep").take(pa.array(member)), b.column("n").take(pa.array(member))
            for k, (tree, c) in enumerate(branches):
                key = T.mix(T.mix(size + np.uint64(tree << 8) + np.uint64(c << 16)) + T.mix(values[member, k]))
                yield pa.RecordBatch.from_arrays([_signed(key), rep, count], names=["node", "rep", "n"])

    return reps.select("rep", "n", "roots").mapInArrow(run, "node bigint, rep bigint, n bigint")


def _grown(big: DataFrame, reps: DataFrame, rules: JoinRules) -> DataFrame:
    """The children of members of large nodes."""

    def run(batches):
        for b in batches:
            own, keys = _children(b.column("node").to_numpy().view(np.uint64), _rows(b.column("short"), np.uint8, COORDINATES), rules.percent)
            yield pa.RecordBatch.from_arrays([_signed(keys), b.column("rep").take(pa.array(own)), b.column("n").take(pa.array(own))], names=["node", "rep", "n"])

    return big.join(reps.select("rep", "short"), "rep").select("node", "rep", "n", "short").mapInArrow(run, "node bigint, rep bigint, n bigint")


class _Bitmap:
    """A bitmap of the keys of a table, of bounded size: leaves out most rows of another that have no partner."""

    def __init__(self, keys: DataFrame):
        name = keys.columns[0]
        bits = FILTER_BITS
        n = keys.count()
        while bits > 1 << 16 and bits > 64 * n:
            bits >>= 1
        self.bits = bits

        def mark(batches):
            for b in batches:
                p = self._places(b.column(name))
                word, place = np.unique(p >> 6, return_inverse=True)
                held = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(held, place, np.uint64(1) << (p & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), _signed(held)], names=["word", "held"])

        marked = np.zeros(max(bits >> 6, 1), np.uint64)
        words = keys.mapInArrow(mark, "word bigint, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()  # at most FILTER_BITS / 64 rows
        marked[words.column("word").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
        self.held = keys.sparkSession.sparkContext.broadcast(marked)

    def __getstate__(self) -> dict:
        return {"bits": self.bits} | ({"held": self.held} if hasattr(self, "held") else {})

    def _places(self, keys: pa.Array) -> np.ndarray:
        return (T.mix(keys.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(self.bits)).astype(np.int64)

    def may_have(self, keys: pa.Array) -> pa.Array:
        p = self._places(keys)
        return pa.array((self.held.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1)


def _among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` that have a partner in the distinct ``keys``, joined on that column."""
    name = keys.columns[0]
    bitmap = _Bitmap(keys)

    def run(batches):
        for b in batches:
            yield b.filter(bitmap.may_have(b.column(name)))

    return df.mapInArrow(run, df.schema).join(keys, name)


def _by_group(f):
    """A mapInArrow function over rows sorted by their first column: ``f`` gets the rows of one group as a table."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(a, e - a)
                if held and held[-1].column(0)[0].as_py() != part.column(0)[0].as_py():
                    yield from f(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from f(pa.Table.from_batches(held))

    return run


def _roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, by label propagation with pointer jumps."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while (jumped := label[label] != label).any():
            label = np.where(jumped, label[label], label)
        if (label == before).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _likely(rules: JoinRules):
    """From the members of one node with their minima to its clusters of likely partners."""
    least = rules.percent / 100 - 4 * np.sqrt(rules.percent / 100 * (1 - rules.percent / 100) / COORDINATES)

    def f(table: pa.Table):
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        values = np.concatenate([T.texts(c).data for c in table.column("short").chunks]).reshape(len(rep), COORDINATES)
        a_, b_ = [], []
        for i in range(len(rep) - 1):
            same = (values[i + 1 :] == values[i]).sum(1, dtype=np.int32)
            near = np.flatnonzero((same >= least * COORDINATES) & (100 * np.minimum(n[i], n[i + 1 :]) >= rules.percent * np.maximum(n[i], n[i + 1 :])))
            a_.append(np.full(len(near), i))
            b_.append(near + i + 1)
        label = _roots_of(len(rep), np.concatenate(a_), np.concatenate(b_)) if a_ else np.arange(len(rep))
        size = np.bincount(label, minlength=len(rep))
        inside = size[label] > 1
        if inside.any():
            rep, label = rep[inside], label[inside]
            hashed = T.mix(rep.view(np.uint64))
            sums, top = np.zeros(len(inside), np.uint64), np.zeros(len(inside), np.uint64)
            np.add.at(sums, label, hashed)
            np.bitwise_xor.at(top, label, T.mix(hashed))
            yield pa.RecordBatch.from_arrays([_signed(T.mix(sums ^ T.mix(top))[label]), pa.array(rep)], names=["cluster", "rep"])

    return f


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, from the shingles that two sets or more hold."""
    g = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    out = np.zeros((g, g), np.float32)
    width = max(256, (8 << 20) // g)
    for a in range(0, int(common.sum()), width):
        low, high = np.searchsorted(column, [a, a + width])
        block = np.zeros((g, min(width, int(common.sum()) - a)), np.float32)
        block[owner[low:high], column[low:high] - a] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verified(rules: JoinRules):
    """From the full sets of one cluster to a spanning forest of its verified links."""

    def f(table: pa.Table):
        found = sorted(set(zip(table.column("rep").to_pylist(), table.column("grams").to_pylist(), strict=True)))
        rep, sets = np.array([r for r, _ in found], np.int64), [np.frombuffer(g, np.uint64) for _, g in found]
        if len(sets) > 1:
            both = intersections(sets)
            n = np.array([len(s) for s in sets])
            a, b = np.nonzero(np.triu(100 * both >= rules.percent * (n[:, None] + n[None, :] - both), 1))
            label = _roots_of(len(rep), a, b)
            linked = np.flatnonzero(rep[label] != rep)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], names=["a", "b"])

    return f


#: Members of a cluster that are verified in one group at most.
GROUP = 512


def _dealt(rows: DataFrame, key: str, limit: int = GROUP) -> DataFrame:
    """Groups of more than ``limit`` rows as pairs of blocks, so that one group is the work of many tasks; all pairs of its rows still meet.

    Blocks follow ``rep`` alone, so that equal groups stay equal.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") * 2 / limit).alias("__blocks")).filter(F.col("__blocks") > 2)
    own, blocks = F.pmod(F.xxhash64("rep"), F.col("__blocks")), F.coalesce("__blocks", F.lit(1))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("__other")
    spread = rows.join(sizes, key, "left").select(*rows.columns, "__blocks", own.alias("__own"), each).filter("__blocks is null or __own <> __other")
    named = F.when(F.col("__blocks").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other")))
    return spread.withColumn(key, named).select(*rows.columns)


def _starred(rules: JoinRules):
    """Whether members of a node, given with their own set and that of the node's pivot, link to the pivot."""

    def run(batches):
        for b in T.chunks(batches, "grams"):
            linked = []
            for own, center in zip(b.column("grams"), b.column("center"), strict=True):
                x, y = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(center.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= rules.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "rep", "n", "pivot")), pa.array(linked, pa.bool_())], names=["node", "rep", "n", "pivot", "linked"])

    return run


def _finished(docs: DataFrame, members: DataFrame, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """Links of pivots (a, b) and clusters (cluster, rep) that hold all other pairs of nodes that stay large."""
    members = written(members.select("node", "rep", "n"), "members")
    sets = _filtered_sets(docs, members.select("rep").distinct(), rules)
    pivots = written(members.groupBy("node").agg(F.min("rep").alias("rep")).join(sets, "rep").select("node", F.col("rep").alias("pivot"), F.col("grams").alias("center")).dropDuplicates(["node"]), "pivots")
    tested = members.join(sets, "rep").join(pivots, "node").select("node", "rep", "n", "pivot", "grams", "center").mapInArrow(_starred(rules), "node bigint, rep bigint, n bigint, pivot bigint, linked boolean")
    tested = written(tested.distinct(), "stars")
    rest = tested.filter("not linked").select("node", "rep", "n")

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        count = F.greatest(F.ceil(F.count("*") * 2 / rules.node_limit), F.ceil(F.sum("n") * 2 / rules.node_shingles))
        return rows.groupBy("node").agg(count.cast("bigint").alias(name))

    counts = written(dealt(rest, "rows").join(dealt(members, "columns"), "node"), "blocks")
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    spread = lambda name: F.pmod(F.xxhash64("rep", "node"), F.col(name))
    down = rest.join(counts, "node").select("node", "rep", spread("rows").alias("i"), upto("columns").alias("j"))
    across = members.join(counts, "node").select("node", "rep", upto("rows").alias("i"), spread("columns").alias("j"))
    clusters = down.union(across).select(F.xxhash64("node", "i", "j").alias("cluster"), "rep")
    return tested.filter("linked and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")), clusters


def _filtered_sets(docs: DataFrame, wanted: DataFrame, rules: JoinRules) -> DataFrame:
    """Full sets of the documents whose id may be among ``wanted``."""
    bitmap = _Bitmap(wanted)

    def run(batches):
        for b in T.chunks(batches, "text"):
            b = b.filter(bitmap.may_have(b.column("id")))
            if b.num_rows:
                g, bounds = shingle_sets(T.texts(b.column("text")), rules.shingle)
                raw = g.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([raw[8 * a : 8 * e] for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["rep", "grams"])

    return docs.mapInArrow(run, "rep bigint, grams binary")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node of the component, for every node of an undirected edge table (a, b)."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u"))
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = written(after, "edges")
        stars = after.groupBy().agg(F.count("*"), F.count_distinct("a")).first()
        changed = after.join(after.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").limit(1).count()
        drop(edges)
        drop(large)
        edges = after
        if not changed and stars[0] == stars[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def link_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules | None = None) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` (smallest linked id) and ``kept``."""
    rules = rules or JoinRules()
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be of an integer type: a class is named by its smallest id")
    T.prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = written(_digested(docs, rules), "sets")
    reps = base.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("roots").alias("roots"), F.first("short").alias("short"), F.count("*").alias("copies"))
    reps = written(reps, "reps")

    level = _roots(reps, rules)
    stars, found, read = None, [], []
    for depth in range(rules.max_depth + 1):
        level = written(level.distinct() if depth else level, "nodes")
        while read:  # what the level before was made of
            drop(read.pop())
        stats = level.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("rep")).alias("h")).filter("c > 1")
        stats = written(stats, "stats")
        fits = (F.col("c") <= rules.node_limit) & ((F.col("s") <= rules.node_shingles) | (F.col("c") <= 2))
        once = written(stats.filter(fits).groupBy("c", "s", "h").agg(F.min("node").alias("node")), "once")  # the same members in several trees are compared once
        small = _among(level, once.select("node"))
        more = stats.filter(~fits).limit(1).count()
        large = level.join(stats.filter(~fits).select("node"), "node")
        near = small.join(reps.select("rep", "short"), "rep").select("node", "rep", "n", "short").repartition("node").sortWithinPartitions("node").mapInArrow(_by_group(_likely(rules)), "cluster bigint, rep bigint")
        found.append(written(near.distinct(), "near"))
        drop(once)
        read = [level, stats]
        if more and depth == rules.max_depth:
            whole = stats.filter(~fits).groupBy("c", "s", "h").agg(F.min("node").alias("node")).select("node")
            stars, blocks = _finished(docs, level.join(whole, "node"), rules)
            found.append(blocks)
        if not more or depth == rules.max_depth:
            break
        level = _grown(large, reps, rules)
    clusters = found[0]
    for other in found[1:]:
        clusters = clusters.union(other)
    clusters = written(clusters.distinct(), "clusters")
    for table in (*read, *(found if stars is None else found[:-1])):
        drop(table)
    wanted = clusters.select("rep").distinct()
    sets = _filtered_sets(docs, wanted, rules).join(_dealt(clusters, "cluster"), "rep").select("cluster", "rep", "grams")
    links = sets.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_by_group(_verified(rules)), "a bigint, b bigint")
    labels = components(links if stars is None else links.union(stars))
    # classes of one row that are linked with nothing need no label
    named = reps.join(labels, F.col("rep") == F.col("node"), "left").filter("label is not null or copies > 1").select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = base.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def filter_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules | None = None) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id.

    Rows without an id stay. Of rows with one id those with equal texts are one
    document, and its first row by the text of all its columns stays; only rows
    whose id occurs again are shuffled for that.
    """
    gone = link_classes(docs, id_col, text_col, rules or JoinRules(percent=STAGE_PERCENT)).filter("not kept").select(id_col).distinct()
    left = docs.join(gone, id_col, "left_anti")
    again = written(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(id_col), "again")
    if not again.limit(1).count():
        return left
    rest = [F.to_json(F.struct(c)) if isinstance(docs.schema[c].dataType, (MapType, VariantType)) else F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    twice = left.join(again, id_col, "left_semi").withColumn("__order", F.struct(*[F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string"))) for c in rest]) if rest else F.lit(0))
    first = twice.groupBy(id_col, text_col).agg(F.min_by(F.struct(*docs.columns), "__order").alias("__row")).select("__row.*")
    return left.join(again, id_col, "left_anti").unionByName(first)
