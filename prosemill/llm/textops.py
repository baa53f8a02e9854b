"""Array kernels over Arrow string columns: words, hashes, windows.

A batch of texts is one byte array with row offsets. Words, n-gram hashes and
line hashes come from whole-array numpy steps, so the work per byte is a few
machine operations and no Python object is made per word. Batches are cut into
chunks of about ``CHUNK`` bytes (one row is never cut), which bounds memory.

All word classes used here are unions of ASCII sets and every non-ASCII
character, so a word is a run of bytes of a 256-entry table.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK = 2 << 20
#: Rows that Spark puts into one Arrow batch at most; bounds the JVM side for very long texts.
BATCH_ROWS = 1000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_class(excluded: Iterable[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NONSPACE = _byte_class([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: a-z, 0-9 and all non-ASCII characters.
ALNUM = _byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(_U)  # noqa: NPY002
_power = np.ones(1, _U)
_inverse = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        a, b = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        a[0] = b[0] = 1
        _power, _inverse = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """Rows of UTF-8 text: ``data`` bytes, ``bounds`` row offsets (n + 1), ``valid`` (False: null)."""

    data: np.ndarray
    bounds: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def texts(column: pa.Array) -> Texts:
    """View an Arrow string column as bytes without copying; a null row is empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool))
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    return Texts(data, bounds - bounds[0], valid)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes; a longer row stays whole, alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = texts(batch.column(column)).bounds
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words in row order: byte ``start`` and ``end``; row r has words ``bounds[r]`` to ``bounds[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(t: Texts, table: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes of ``table`` that do not cross rows."""
    data = t.data if data is None else data
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(t.bounds), np.int64))
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[t.bounds[:-1][t.bounds[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[t.bounds[1:][t.bounds[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.bounds))


class SpanHash:
    """Hashes of byte spans of one array, each in constant time from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_VALUE[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(_U))


_STEP = _U(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; runs over a row's end are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, _U)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= _STEP
        g += h[k : len(h) - n + 1 + k]
    return mix(g + _U(n))


def gram_hash(h: Iterable[int]) -> int:
    """The hash ``grams`` gives to this whole sequence of word hashes."""
    a = np.array(list(h), _U)
    return int(grams(a, len(a))[0])


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Indexes of words at which a window of ``n`` words fits into its row."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + first


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``keys``: equal to another one, equal to an earlier one."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        twice |= later
        twice[order[:-1][same]] = True
    return twice, later


def covered(starts: np.ndarray, n: int | np.ndarray, total: int) -> np.ndarray:
    """Mask of the ``total`` positions that lie in [start, start + n) of any start."""
    delta = np.zeros(total + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + n, -1)
    return np.cumsum(delta[:-1]) > 0


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Arrow functions of this package.

    Batches are held at ``BATCH_ROWS`` rows, so that long texts do not add up in
    one, and the package's source is sent to the executors, which need not have
    it installed.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def per_chunk(column: str, schema: pa.Schema, f: Callable[[pa.RecordBatch], dict]) -> Callable:
    """A mapInArrow function that applies ``f`` to bounded chunks; ``f`` returns arrays by column name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column):
            made = f(chunk)
            yield pa.RecordBatch.from_arrays([a if isinstance(a := made[x.name], pa.Array) else pa.array(a, x.type) for x in schema], schema=schema)

    return run
