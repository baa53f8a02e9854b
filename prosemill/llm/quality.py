"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over each whole text in
numpy. For every length, the characters of words that lie in an n-gram which
occurs twice or more in the text (first included) are measured, and so are the
characters in lines equal to an earlier line. A text passes when each share
stays at or under its limit.

Defined results: a null or empty text has no words, all counts 0, and fails the
base rule; repeated rows give repeated results; a null id is kept as it is;
other columns of the input are not read. Work per text is linear, so one very
long text costs its own length only. No shuffle is made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    """Limits. As in published web-text filters, longer n-grams have lower shares. No share is under the
    fifth that the base rule grants, so that a header and a footer line that are equal do not cost a text."""

    min_words: int = 10
    #: Percent of words in repeated five-word windows above which the base rule fails.
    max_repeat_percent: int = 20
    #: n-gram length to the largest share of word characters inside duplicated n-grams.
    gram_shares: dict[int, float] = field(default_factory=lambda: {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20})
    #: Largest share of word characters inside lines equal to an earlier line.
    line_share: float = 0.20
    #: Largest number of markup symbols per word character.
    symbol_share: float = 0.05


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_gram_chars map<int,long>, base_failed boolean, kept boolean"


def measure(t: T.Texts, rules: QualityRules) -> dict[str, np.ndarray | dict[int, np.ndarray]]:
    """All measures of the rows of ``t``."""
    w = T.words(t, T.NONSPACE)
    spans = T.SpanHash(t.data)
    rows = w.row()
    salt = T.mix(np.arange(len(t), dtype=np.uint64) + np.uint64(1))
    h = spans(w.start, w.end)
    points = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    out: dict = {"n_words": np.diff(w.bounds), "word_chars": T.row_sums(chars, w.bounds)}
    out["n_symbols"] = T.row_sums(_SYMBOL[t.data], t.bounds)

    found: dict[int, np.ndarray] = {}
    hot = None
    for n in sorted({5, *rules.gram_shares}):
        starts = T.window_starts(w.bounds, n)
        if hot is not None:  # a longer window repeats only where the shorter one does
            starts = starts[hot[starts]]
        g = h[starts].copy()
        for k in range(1, n):
            g *= T._STEP
            g += h[starts + k]
        twice, _ = T.repeated(T.mix(g) ^ salt[rows[starts]])
        hot = np.zeros(len(h), bool)
        hot[starts[twice]] = True
        found[n] = T.covered(starts[twice], n, len(h))
    out["n_repeat_words"] = T.row_sums(found[5], w.bounds)
    out["dup_gram_chars"] = {n: T.row_sums(found[n] * chars, w.bounds) for n in sorted(rules.gram_shares)}

    cut = np.flatnonzero(t.data == 10)
    filled = t.bounds[:-1][np.diff(t.bounds) > 0]
    start = np.union1d(filled, cut + 1)
    start = start[start < len(t.data)]
    stop = np.concatenate((start[1:], [len(t.data)])) if len(start) else start
    row_of = np.searchsorted(t.bounds, start, "right") - 1
    end = np.where(np.isin(stop - 1, cut, assume_unique=True), stop - 1, stop) if len(cut) else stop
    line_words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    has = line_words > 0
    _, later = T.repeated(spans(start[has], end[has]) ^ salt[row_of[has]])
    out["n_dup_lines"] = np.bincount(row_of[has][later], minlength=len(t))
    sums = np.concatenate(([0], np.cumsum(chars)))
    first, last = np.searchsorted(w.start, start[has]), np.searchsorted(w.start, end[has])
    in_line = (sums[last] - sums[first])[later]
    out["dup_line_chars"] = np.bincount(row_of[has][later], weights=in_line, minlength=len(t)).astype(np.int64)

    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    total = np.maximum(out["word_chars"], 1)
    fine = (out["dup_line_chars"] <= rules.line_share * total) & (out["n_symbols"] <= rules.symbol_share * total)
    for n, limit in rules.gram_shares.items():
        fine &= out["dup_gram_chars"][n] <= limit * total
    out["kept"] = ~out["base_failed"] & fine
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """One row per input row: the id with every measure and the verdict."""
    rules = rules or QualityRules()
    T.prepare(df.sparkSession)
    wanted = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for b in T.chunks(batches, "__text"):
            m = measure(T.texts(b.column("__text")), rules)
            lens = sorted(m["dup_gram_chars"])
            grams = np.stack([m["dup_gram_chars"][n] for n in lens], 1).ravel() if lens else np.zeros(0, np.int64)
            maps = pa.MapArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(lens), pa.int32()), pa.array(np.tile(np.array(lens, np.int32), b.num_rows)), pa.array(grams))
            arrays = [b.column("__id"), *[pa.array(m[c].astype(np.int64)) for c in NAMES], maps, pa.array(m["base_failed"]), pa.array(m["kept"])]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", *NAMES, "dup_gram_chars", "base_failed", "kept"])

    made = wanted.mapInArrow(run, f"__id {wanted.schema['__id'].dataType.simpleString()}, {SCHEMA}")
    return made.withColumnRenamed("__id", id_col)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    rules = rules or QualityRules()
    T.prepare(docs.sparkSession)

    def run(batches):
        for b in T.chunks(batches, text_col):
            kept = b.filter(pa.array(measure(T.texts(b.column(text_col)), rules)["kept"]))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
