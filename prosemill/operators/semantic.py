"""Measures and findings over sentence embeddings.

Input: one row per sentence with its document, its order and a unit vector.
A document's vectors are gathered once; adjacent similarities are a walk over
that array. The pair measures of a document run in one Arrow group function
whose memory is blocks of the similarity matrix, never all pairs as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules.packs import DEFAULT, Profile


def dot(a, b):
    """Dot product of two float arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def adjacent_metrics(vectors: DataFrame, doc: str = "doc", ix: str = "ix", vec: str = "vec") -> DataFrame:
    """Per document: sentences, and range, minimum and variance of the similarity of neighbours."""
    w = Window.partitionBy(doc).orderBy(ix)
    pairs = vectors.select(doc, dot(F.col(vec), F.lead(vec).over(w)).alias("s"))
    return pairs.groupBy(doc).agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("flatness_range"), F.min("s").alias("topic_jump_min"), F.var_pop("s").alias("adjacent_var"))


def pair_metrics(vectors: DataFrame, doc: str = "doc", ix: str = "ix", vec: str = "vec", block: int = 1024) -> DataFrame:
    """Per document: maximum and 95th percentile of the similarity of sentences that are no neighbours.

    Memory is the document's vectors as one array, and square blocks of the similarity
    matrix: similarities are counted in bins, and only those of the bins that hold the
    percentile are gathered, in a second pass.
    """
    kind = vectors.schema[doc].dataType.simpleString()

    def measure(key: tuple, rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows["ix"]).to_numpy()
        m = pc.list_flatten(rows["vec"]).to_numpy().reshape(len(order), -1)[order]
        top, high = percentile_of_pairs(m, 95, block)
        return pa.table({doc: pa.array([key[0].as_py()], rows.schema.field(doc).type), "repetition_max": pa.array([top], pa.float64()), "repetition_p95": pa.array([high], pa.float64())})

    rows = vectors.select(doc, F.col(ix).alias("ix"), F.col(vec).alias("vec"))
    return rows.groupBy(doc).applyInArrow(measure, f"{doc} {kind}, repetition_max double, repetition_p95 double")


def percentile_of_pairs(m: np.ndarray, percent: float, block: int, bins: int = 1 << 16, held: int = 1 << 22) -> tuple[float | None, float | None]:
    """Maximum and interpolated percentile of the dot products of rows at least two apart.

    Where more than ``held`` values share the percentile's bins, as those of copies do,
    the bins are divided again until fewer are left or they are all one value.
    """
    n = len(m)
    if n < 3:
        return None, None
    pairs = (n - 1) * (n - 2) // 2

    def blocks():
        for a in range(0, n, block):
            own = m[a : a + block].astype(np.float64)
            for b in range(a, n, block):
                v = own @ m[b : b + block].astype(np.float64).T
                yield v.ravel() if b > a + block else v[np.arange(b, b + v.shape[1])[None, :] >= np.arange(a, a + len(own))[:, None] + 2]

    bound = max(float(np.sqrt((m[a : a + block].astype(np.float64) ** 2).sum(1).max())) for a in range(0, n, block)) ** 2 or 1.0
    at = percent / 100 * (pairs - 1)
    low = int(at)
    ranks = (low, min(low + 1, pairs - 1))
    left, right, before, top = -bound, bound, 0, -np.inf
    # rounding takes a product beyond the bound, so the first pass counts what lies outside in its end bins
    first_pass = True
    while True:
        place = lambda v: np.clip(((v - left) / (right - left) * bins).astype(np.int64), 0, bins - 1)  # noqa: B023, E731
        inside = lambda v: v if first_pass else v[(v >= left) & (v <= right)]  # noqa: B023, E731
        counts = np.zeros(bins, np.int64)
        for v in blocks():
            v = inside(v)
            if len(v):
                p = place(v)
                counts += np.bincount(p, minlength=bins)
                if first_pass:
                    top = max(top, float(v.max()))
        upto = before + np.cumsum(counts)
        a, b = (int(np.searchsorted(upto, k, "right")) for k in ranks)
        skipped = int(upto[a - 1]) if a else before
        if int(upto[b]) - skipped <= held:
            kept = np.sort(np.concatenate([v[(p >= a) & (p <= b)] for v in map(inside, blocks()) for p in (place(v),)]))
            x, y = kept[ranks[0] - skipped], kept[ranks[1] - skipped]
            break
        # the least and largest value of those bins bound the next division
        least_, most_ = np.inf, -np.inf
        for v in map(inside, blocks()):
            p = place(v)
            v = v[(p >= a) & (p <= b)]
            if len(v):
                least_, most_ = min(least_, float(v.min())), max(most_, float(v.max()))
        if most_ - least_ <= 1e-12 * bound or (least_, most_) == (left, right):
            x, y = least_, most_
            break
        left, right, before, first_pass = least_, most_, skipped, False
    return top, float(x + (y - x) * (at - low))


def semantic_findings(metrics: DataFrame, profile: Profile = DEFAULT, doc: str = "doc") -> DataFrame:
    """Flat neighbours (warn), low maximum similarity and high minimum similarity (info), for enough sentences."""
    f = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity")))
    hits = F.array(
        f(F.col("flatness_range") <= profile.flatness, "semantic_topic_flatness", "warn"),
        f(F.col("repetition_max") <= profile.repetition_max, "semantic_repetition_max", "info"),
        f(F.col("topic_jump_min") >= profile.topic_jump, "topic_jump_min", "info"),
    )
    return metrics.filter(F.col("n") >= profile.semantic_min_sentences).select(doc, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select(doc, "x.*")


def document_vector(vectors: DataFrame, doc: str = "doc", vec: str = "vec") -> DataFrame:
    """Mean vector per document, not normalised; sums are aggregated by position."""
    each = vectors.select(doc, F.posexplode(vec).alias("k", "x")).groupBy(doc, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda z: z["x"]).alias("vec"))
