"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece of the vocabulary can span (a pair of
bytes that stands in no piece), equal cuts are kept once, and what a worker has
not met before is concatenated and indexed by a suffix array. Every piece of the
vocabulary is then found by binary search as a range of suffixes; the ranges are
the edges of a lattice. Edges are sorted by position and relaxed from left to
right: an edge reaches its end if its piece may follow the piece that reached its
start, which for byte-pair merges holds for exactly one edge at every end, so the
path to the last position is the encoding that the merges would give.

The vocabulary is read from a public model file (its path is a parameter) and is
never trained here. White space and unknown characters follow the model: a space
is written as U+2581 with one in front of the text, and a character without a
piece becomes its bytes.

Scale: one pass, no shuffle; the vocabulary (a fixed file) is broadcast. What a
worker remembers of cuts is bounded and only saves work. A cut of any length (an
unbroken blob, a run of dashes) takes time in proportion to its length, and is
indexed in segments.

Defined results: a null text has null ids and counts of 0; an empty one no ids;
U+2581 in a text decodes as a space, so such a text has ``round_trip`` false; a
null id stays; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, GAP = 0xFF, 0xFE  # bytes that UTF-8 never uses: for U+2581, and between cuts
_MARK = "▁".encode()


@dataclass
class Vocabulary:
    """Pieces as bytes (U+2581 is ``SPACE``), their merge ranks, and the first id of the 256 byte pieces."""

    pieces: list[bytes | None]
    rank: np.ndarray
    first_byte: int

    @staticmethod
    def load(path: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)]
        pieces = [None if s else p.id_to_piece(i).encode().replace(_MARK, bytes([SPACE])) for i, s in enumerate(special)]
        score = np.array([p.get_score(i) for i in range(n)])
        return Vocabulary(pieces, np.argsort(np.argsort(-score, kind="stable"), kind="stable"), next(i for i in range(n) if p.is_byte(i)))


def _chars(piece: bytes) -> list[bytes]:
    cut = [k for k, b in enumerate(piece) if b & 0xC0 != 0x80 or b == SPACE] + [len(piece)]
    return [piece[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Codec:
    """Encoder and decoder of one vocabulary, for arrays of texts."""

    REMEMBERED = 2_000_000
    #: Bytes above which a cut is relaxed on its own, and bytes of such a cut that are indexed together.
    LONG, SEGMENT = 512, 1 << 18

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.id_of = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.rank = vocabulary.rank
        self.ranks: list[int] = vocabulary.rank.tolist()
        n = len(vocabulary.pieces)
        self.size = np.array([len(p) if p else 0 for p in vocabulary.pieces], np.int64)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        whole = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        adjacent = np.zeros((256, 256), bool)
        for p, i in self.id_of.items():
            adjacent[list(p[:-1]), list(p[1:])] = True
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        for p, i in self.id_of.items():
            symbols = [self.id_of.get(c) for c in _chars(p)]
            if None not in symbols:
                whole[i] = len(symbols) == 1 or self._merge(symbols, i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.birth = np.where(self.left >= 0, self.rank, -1)
        self.births: list[int] = self.birth.tolist()
        self.followed: dict[int, bool] = {}
        #: Pieces that stand for themselves when encoded alone; no other piece is ever used.
        self.usable = np.flatnonzero(whole)
        self.adjacent = adjacent.ravel()
        one = [c for c in self.id_of if len(_chars(c)) == 1]
        self.known_ascii = np.zeros(256, bool)
        self.known_ascii[[c[0] for c in one if len(c) == 1]] = True
        self.known_wide = np.array(sorted(ord(c.decode()) for c in one if len(c) > 1), np.int64)
        longest = int(self.size[self.usable].max())
        self.words = -(-longest // 8)
        padded = np.zeros((len(self.usable), 8 * self.words), np.uint8)
        filled = np.full_like(padded, 255)
        for r, i in enumerate(self.usable.tolist()):
            p = np.frombuffer(vocabulary.pieces[i], np.uint8)
            padded[r, : len(p)] = filled[r, : len(p)] = p
        self.low = padded.view(">u8").astype(np.uint64)
        self.high = filled.view(">u8").astype(np.uint64)
        b = vocabulary.first_byte
        self.text_of = [p if p is not None else bytes([i - b]) if b <= i < b + 256 else b"" for i, p in enumerate(vocabulary.pieces)]
        self.bytes = np.frombuffer(b"".join(self.text_of), np.uint8)
        self.byte_bounds = np.concatenate(([0], np.cumsum([len(x) for x in self.text_of])))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _merge(self, symbols: list[int], target: int | None = None) -> bool | list[int]:
        """Apply merges in order of rank, leftmost first. With ``target``: is it the result, noting its last merge?"""
        n, size, get = len(self.vocabulary.pieces), len(symbols), self.pairs.get
        rank = self.ranks
        own: list[int] = list(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank[m], k, own[k], own[k + 1], m) for k in range(size - 1) if (m := get(own[k] * n + own[k + 1])) is not None]
        heapq.heapify(heap)
        left = size
        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            j = after[k]
            if own[k] != a or j >= size or own[j] != b:
                continue
            if left == 2 and m == target:
                self.left[m], self.right[m] = a, b
            own[k], own[j], left = m, -1, left - 1
            after[k] = e = after[j]
            if e < size:
                before[e] = k
                if (x := get(m * n + own[e])) is not None:
                    heapq.heappush(heap, (rank[x], k, m, own[e], x))
            if (c := before[k]) >= 0 and (x := get(own[c] * n + m)) is not None:
                heapq.heappush(heap, (rank[x], c, own[c], m, x))
        left_over = [x for x in own if x >= 0]
        return left_over == [target] if target is not None else left_over

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the merged pair, or -1."""
        key = a * len(self.vocabulary.pieces) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a: do merges leave the boundary between them alone?

        Both pieces are taken apart along the boundary, the later merge first; at
        every stage the two symbols at the boundary must not have merged before the
        stage ended. Of equal ranks the merge further left is the earlier one.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            m = self._pair(a, b)
            clash = (m >= 0) & (self.rank[m] < limit)
            out[at[clash]] = False
            on = ~clash & ((self.birth[a] >= 0) | (self.birth[b] >= 0))
            a, b, at = a[on], b[on], at[on]
            first = self.birth[a] > self.birth[b]
            limit = np.where(first, self.birth[a], self.birth[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _follows_one(self, a: int, b: int) -> bool:
        """``follows`` for one pair, remembered."""
        key = a << 20 | b
        if (known := self.followed.get(key)) is not None:
            return known
        n, limit, birth = len(self.vocabulary.pieces), 1 << 62, self.births
        while True:
            m = self.pairs.get(a * n + b)
            if m is not None and self.ranks[m] < limit:
                fine = False
                break
            if birth[a] < 0 and birth[b] < 0:
                fine = True
                break
            if birth[a] > birth[b]:
                limit, a = birth[a], int(self.right[a])
            else:
                limit, b = birth[b] + 1, int(self.left[b])
        if len(self.followed) > self.REMEMBERED:
            self.followed.clear()
        self.followed[key] = fine
        return fine

    def _encode_long(self, x: np.ndarray) -> list[int]:
        """Ids of one long cut by the same lattice, in segments: edges are found, sorted and relaxed for ``SEGMENT`` bytes at a time."""
        n, longest = len(x), 8 * self.words
        reached = array("i", [-1]) * (n + 1)
        at, piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, n, self.SEGMENT):
            b = min(a + self.SEGMENT, n)
            new, own = self.edges(x[a : min(b + longest, n)])
            own, new = own[new < b - a], new[new < b - a] + a
            at, piece = np.concatenate((at, new)), np.concatenate((piece, own))
            end = at + self.size[piece]
            now = end <= b
            order = np.lexsort((-self.size[piece[now]], end[now]))
            for s, p, e in zip(at[now][order].tolist(), piece[now][order].tolist(), end[now][order].tolist(), strict=True):
                if reached[e] < 0 and (s == 0 or (reached[s] >= 0 and self._follows_one(reached[s], p))):
                    reached[e] = p
            at, piece = at[~now], piece[~now]
        ids, cur = [], n
        while cur > 0:
            ids.append(reached[cur])
            cur -= int(self.size[reached[cur]])
        return ids[::-1]

    def suffixes(self, x: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """Suffix array of ``x``, ordered by as many bytes as the longest piece has at least."""
        order = np.argsort(words[0], kind="stable")
        depth = 8
        rank = np.empty(len(x), np.int64)
        sorted_key = words[0][order]
        while True:
            new = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
            rank[order] = np.cumsum(new)
            if depth >= 8 * self.words or rank[order[-1]] == len(x) - 1:
                return order
            key = rank << np.int64(32)
            key[: len(x) - depth] += rank[depth:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            depth *= 2

    def edges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a usable piece in ``x``."""
        padded = np.concatenate((x, np.zeros(8 * self.words + 8, np.uint8))).astype(np.uint64)
        word = np.zeros(len(x) + 8 * self.words, np.uint64)
        for k in range(8):
            word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)
        order = self.suffixes(x, [word[: len(x)]])
        heads = word[order]
        lo, hi = np.searchsorted(heads, self.low[:, 0], "left"), np.searchsorted(heads, self.high[:, 0], "right")
        size = self.size[self.usable]
        for j in range(1, self.words):
            own = np.flatnonzero((hi > lo) & (size > 8 * j))
            for side, key, edge in ((lo, self.low, "left"), (hi, self.high, "right")):
                a, b = lo[own].copy(), hi[own].copy()
                if edge == "right":
                    a = lo[own].copy()
                goal = key[own, j]
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    seen = word[order[np.minimum(mid, len(order) - 1)] + 8 * j]
                    after = seen < goal if edge == "left" else seen <= goal
                    a = np.where(open_ & after, mid + 1, a)
                    b = np.where(open_ & ~after, mid, b)
                side_new = a
                if edge == "left":
                    low_new = side_new
                else:
                    lo[own], hi[own] = low_new, side_new
        n = np.maximum(hi - lo, 0)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return order[place], np.repeat(self.usable, n)

    def _encode_cuts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts of known characters, and bounds, by the lattice."""
        n = len(start)
        width = size + 1
        begin = np.cumsum(width) - width
        x = np.full(int(width.sum()), GAP, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        x[inner + np.repeat(begin, size)] = data[inner + np.repeat(start, size)]
        owner = np.repeat(np.arange(n), width)
        at, piece = self.edges(x)
        owned = owner[at]
        end = at - begin[owned] + self.size[piece]
        order = np.argsort((end << np.int64(40)) | (owned << np.int64(7)) | (127 - self.size[piece]), kind="stable")
        at, piece, owned, end = at[order], piece[order], owned[order], end[order]
        reached = np.full(len(x) + 1, -1, np.int64)
        wave = np.concatenate(([0], np.flatnonzero(np.diff(end)) + 1, [len(end)]))
        for a, b in zip(wave[:-1].tolist(), wave[1:].tolist(), strict=True):
            if a == b:
                continue
            s, p, o = at[a:b], piece[a:b], owned[a:b]
            new = np.concatenate(([True], o[1:] != o[:-1]))
            group = np.cumsum(new) - 1
            turn = np.arange(b - a) - np.flatnonzero(new)[group]
            done = np.zeros(int(group[-1]) + 1, bool)
            for k in range(int(turn.max()) + 1):  # longest piece first; exactly one reaches
                i = np.flatnonzero((turn == k) & ~done[group])
                before = reached[s[i]]
                root = s[i] == begin[o[i]]
                fine = root.copy()
                check = np.flatnonzero(~root & (before >= 0))
                fine[check] = self.follows(before[check], p[i[check]])
                done[group[i[fine]]] = True
                reached[s[i[fine]] + self.size[p[i[fine]]]] = p[i[fine]]
        cur, live = begin + size, np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(n, np.int64)
        while len(live):
            p = reached[cur[live]]
            steps.append((live, p))
            count[live] += 1
            cur[live] -= self.size[p]
            live = live[cur[live] > begin[live]]
        bounds = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(int(bounds[-1]), np.int32)
        for k, (own, p) in enumerate(steps):
            ids[bounds[own + 1] - 1 - k] = p
        return ids, bounds

    def _normal(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with spaces as ``SPACE`` and one in front of each row that is not empty, and row bounds."""
        data, bounds = t.data, t.bounds
        raw = data.tobytes()
        if _MARK in raw:
            rows = [raw[a:b].replace(_MARK, bytes([SPACE])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            data, bounds = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        filled = np.flatnonzero(np.diff(bounds) > 0)
        x = np.insert(np.where(data == 32, np.uint8(SPACE), data), bounds[filled], np.uint8(SPACE))
        return x, bounds + np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))

    def _unknown(self, x: np.ndarray) -> np.ndarray:
        """Mask of bytes that belong to characters without a piece."""
        out = ~self.known_ascii[x] & (x < 0x80)
        lead = np.flatnonzero((x >= 0xC0) & (x < SPACE))
        if len(lead):
            width = 2 + (x[lead] >= 0xE0) + (x[lead] >= 0xF0)
            code = x[lead].astype(np.int64) & (0x7F >> width)
            for k in (1, 2, 3):
                more = width > k
                code[more] = (code[more] << 6) | (x[lead[more] + k] & 0x3F)
            at = np.minimum(np.searchsorted(self.known_wide, code), len(self.known_wide) - 1)
            for a, w in zip(lead[(bad := self.known_wide[at] != code)].tolist(), width[bad].tolist(), strict=True):
                out[a : a + w] = True
        return out

    def encode(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and row bounds."""
        x, bounds = self._normal(t)
        if not len(x):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        unknown = self._unknown(x)
        cut = np.ones(len(x), bool)
        cut[1:] = ~self.adjacent[x[:-1].astype(np.int64) * 256 + x[1:]] | (unknown[1:] != unknown[:-1])
        cut[1:] |= unknown[1:]
        inside = (x & 0xC0 == 0x80) & ~unknown
        cut[inside] = False
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.concatenate((start, [len(x)])))
        keys, first, place = np.unique(T.SpanHash(x)(start, start + size), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.REMEMBERED or len(self.ids) > 8 * self.REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], x, start[first[new]], size[first[new]], unknown)
        entry = self.at[np.searchsorted(self.keys, keys)][place]
        count = self.bounds[entry + 1] - self.bounds[entry]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.arange(int(total[-1])) - np.repeat(total[:-1] - self.bounds[entry], count)]
        return ids, total[np.searchsorted(start, bounds)]

    def _learn(self, keys: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray, unknown: np.ndarray) -> None:
        """Encode cuts and remember their ids."""
        plain = np.ones(len(keys), bool)
        plain[unknown[start]] = False
        # in runs of spaces one piece comes of different pairs; such cuts are merged in order of rank
        runs = np.concatenate(([0], np.cumsum((x[1:] == SPACE) & (x[:-1] == SPACE)), [0]))
        tied = (runs[start + size - 1] > runs[start]) & plain
        plain &= ~tied
        long = plain & (size > self.LONG)
        lists: list[tuple[int, list[int]]] = [(i, self._encode_long(x[start[i] : start[i] + size[i]])) for i in np.flatnonzero(long).tolist()]
        for i in np.flatnonzero(~plain).tolist():
            own = x[start[i] : start[i] + size[i]].tobytes()
            lists.append((i, self._merge([self.id_of[c] for c in _chars(own)]) if tied[i] else [self.vocabulary.first_byte + b for b in own]))
        index = np.flatnonzero(plain & ~long)
        ids, bounds = self._encode_cuts(x, start[index], size[index]) if len(index) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        more = np.array([k for _, own in lists for k in own], np.int32)
        ends = np.cumsum([len(own) for _, own in lists]).astype(np.int64)
        index = np.concatenate((index, np.array([i for i, _ in lists], np.int64)))
        base = len(self.bounds) - 1
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + bounds[1:], self.bounds[-1] + bounds[-1] + ends))
        self.ids = np.concatenate((self.ids, ids, more))
        both, at = np.concatenate((self.keys, keys[index])), np.concatenate((self.at, base + np.arange(len(index))))
        order = np.argsort(both)
        self.keys, self.at = both[order], at[order]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows, and row bounds."""
        size = self.byte_bounds[ids + 1] - self.byte_bounds[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        x = self.bytes[np.arange(int(total[-1])) - np.repeat(total[:-1] - self.byte_bounds[ids], size)]
        edge = total[bounds]
        lead = edge[:-1][np.diff(edge) > 0]
        lead = lead[x[lead] == SPACE]
        x = np.where(x == SPACE, np.uint8(32), x)
        gone = np.zeros(len(x) + 1, np.int64)
        gone[lead + 1] = 1
        return np.delete(x, lead), edge - np.cumsum(gone)[edge]


def codec(df: DataFrame, model_path: str = DEFAULT_MODEL) -> Broadcast:
    """The codec of a model file, readable by the driver, sent to the executors."""
    T.prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Codec(Vocabulary.load(model_path)))


def encode(df: DataFrame, held: Broadcast, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_byte_tokens``, ``ids_sha256`` (of little-endian 32-bit ids), ``round_trip`` and, unless left out, ``ids``."""
    wanted = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    names = ["__id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", *(["ids"] if ids else [])]

    def run(batches):
        own = held.value
        first = own.vocabulary.first_byte
        for b in T.chunks(batches, "__text"):
            t = T.texts(b.column("__text"))
            found, bounds = own.encode(t)
            data, edges = own.decode(found, bounds)
            same = edges[1:] - edges[:-1] == np.diff(t.bounds)
            raw, back = t.data.tobytes(), data.tobytes()
            if raw != back:
                same &= np.array([raw[a:e] == back[c:d] for a, e, c, d in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)], bool)
            little = found.astype("<i4").tobytes()
            fallback = T.row_sums((found >= first) & (found < first + 256), bounds)
            arrays = [b.column("__id"), pa.array(np.diff(bounds)), pa.array(fallback), pa.array([hashlib.sha256(little[4 * a : 4 * e]).hexdigest() for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]), pa.array(same & t.valid)]
            if ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found), mask=None if t.valid.all() else pa.array(~t.valid)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"__id {wanted.schema['__id'].dataType.simpleString()}, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return wanted.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def decode(df: DataFrame, held: Broadcast, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``; ids outside the vocabulary and null ids stand for nothing."""
    wanted = df.select(F.col(id_col).alias("__id"), F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches):
        own = held.value
        for b in batches:
            lists = b.column("__ids").to_pylist()
            rows = [np.array([i for i in x or () if i is not None and 0 <= i < len(own.size)], np.int64) for x in lists]
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            data, edges = own.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), bounds)
            raw = data.tobytes()
            texts = [None if x is None else raw[a:e].decode("utf-8", "replace") for x, a, e in zip(lists, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(texts, pa.string())], names=["__id", "text"])

    return wanted.mapInArrow(run, f"__id {wanted.schema['__id'].dataType.simpleString()}, text string").withColumnRenamed("__id", id_col)
