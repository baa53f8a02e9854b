"""Cross-entropy difference of two n-gram models that share one vocabulary.

Tokens are the bytes of a text, so both models share the 256 symbols and no
token is unknown. Four-gram counts are gathered over the target rows and, for the
background, over all other rows. The models are matched: background counts are
weighted by one factor so that both corpora have the same number of tokens, which
gives the smoothing, a Dirichlet interpolation of the orders, the same say in
both; every row counts, none is sampled. For every
position the loss under the target model minus the loss under the background
model is taken, and a document's score is the mean of these differences: the
lower, the more it is like the target.

Scale: counting pre-aggregates in each task and shuffles one row per task and
different four-gram, over all rows of the corpus; smoothing is joins and sums of
those tables. Scoring reads the model in blocks of at most ``BLOCK_ROWS``
four-grams, one scan stage for each, so what is broadcast is bounded however
many four-grams the corpus has; every four-gram counts, none is pruned. Target
rows are selected by a join on their ids, which are broadcast only up to a counted
size, so that texts are not shuffled for it.

Defined results: a null or empty text has no token, null losses and a null
score; repeated rows repeat (and count repeatedly); with no target row, or no
other, that model is uniform; a null id is never a target; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import drop, written

BLOCK_ROWS = 4_000_000
#: Target ids that are broadcast (16 bytes each); more of them are joined with a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class LmRules:
    #: Weight of the lower order, in observations.
    strength: float = 8.0


def four_grams(t: T.Texts) -> np.ndarray:
    """Each byte with the three before it in its row (zeros before the start), packed."""
    x = t.data.astype(np.uint32)
    out = x.copy()
    start = np.repeat(t.bounds[:-1], np.diff(t.bounds))
    place = np.arange(len(x)) - start
    for k in (1, 2, 3):
        before = np.zeros(len(x), np.uint32)
        before[k:] = x[:-k] if k < len(x) + 1 else 0
        before[place < k] = 0
        out |= before << np.uint32(8 * k)
    return out


def count_grams(texts: DataFrame, name: str) -> DataFrame:
    """``gram`` and its count over all rows of the one-column table ``texts``."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in T.chunks(batches, "__text"):
            k, n = np.unique(four_grams(T.texts(b.column("__text"))), return_counts=True)
            both, more = np.concatenate((keys, k)), np.concatenate((counts, n))
            keys, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, more, len(keys)).astype(np.int64)
            if len(keys) > BLOCK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["gram", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    return texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias(name))


def losses(target: DataFrame, whole: DataFrame, rules: LmRules) -> DataFrame:
    """``gram`` with its loss under either model, for every four-gram of the corpus, from its counts in the target (t) and in all rows (b). Written."""
    grams = written(whole.join(target, "gram", "left").select("gram", (F.col("b") - F.coalesce("t", F.lit(0))).alias("b"), F.coalesce("t", F.lit(0)).alias("t")), "grams")
    tokens = grams.agg(F.sum("t").alias("t"), F.sum("b").alias("b")).first()
    share = (tokens.t or 0) / tokens.b if tokens.b and tokens.t else 1.0
    counts = grams.withColumn("b", F.col("b") * F.lit(share))

    def smoothed(order: int, lower: DataFrame | None) -> DataFrame:
        mask = (1 << 8 * order) - 1
        own = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")) if order < 4 else counts.withColumnRenamed("gram", "g")
        context = own.groupBy(F.shiftright("g", 8).alias("c")).agg(F.sum("t").alias("ct"), F.sum("b").alias("cb"))
        own = own.withColumn("c", F.shiftright("g", 8)).join(context, "c")
        if lower is None:
            own = own.withColumn("lt", F.lit(1 / 256)).withColumn("lb", F.lit(1 / 256))
        else:
            own = own.withColumn("suffix", F.col("g").bitwiseAND(F.lit(mask >> 8))).join(lower.select(F.col("g").alias("suffix"), F.col("pt").alias("lt"), F.col("pb").alias("lb")), "suffix")
        k = rules.strength
        return own.select("g", ((F.col("t") + k * F.col("lt")) / (F.col("ct") + k)).alias("pt"), ((F.col("b") + k * F.col("lb")) / (F.col("cb") + k)).alias("pb"))

    orders: list[DataFrame] = []
    for order in (1, 2, 3):
        orders.append(written(smoothed(order, orders[-1] if orders else None), f"order{order}"))
    out = smoothed(4, orders[-1]).select(F.col("g").alias("gram"), (-F.log("pt")).cast("float").alias("target_loss"), (-F.log("pb")).cast("float").alias("background_loss"))
    out = written(out, "losses")
    for used in (grams, *orders):
        drop(used)
    return out


def score_cross_entropy(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LmRules | None = None) -> DataFrame:
    """Per row: id, ``n_tokens``, mean ``target_loss`` and ``background_loss``, and ``score`` (their difference).

    ``target_ids`` has one column, the ids of the rows that make the target corpus.
    """
    rules = rules or LmRules()
    spark = df.sparkSession
    T.prepare(spark)
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    ids = written(target_ids.select(F.col(target_ids.columns[0]).alias("__id")).distinct(), "targets")
    chosen = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__id", "left_semi")
    table = losses(count_grams(chosen.select("__text"), "t"), count_grams(docs.select("__text"), "b"), rules)
    blocks = max(1, -(-table.count() // BLOCK_ROWS))
    out = docs.select("__id", "__text", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("t"), F.lit(0.0).alias("b"))
    schema = out.schema
    for block in range(blocks):
        part = table.filter(F.pmod("gram", F.lit(blocks)) == block).toArrow() if blocks > 1 else table.toArrow()
        keys = part.column("gram").to_numpy().astype(np.uint32)
        order = np.argsort(keys)
        both = np.stack([part.column(c).to_numpy()[order] for c in ("target_loss", "background_loss")])
        held = spark.sparkContext.broadcast((keys[order], both))
        del part

        def run(batches, held=held):
            keys, both = held.value
            for b in T.chunks(batches, "__text"):
                t = T.texts(b.column("__text"))
                g = four_grams(t)
                sums = np.zeros((2, len(g) + 1))
                if len(keys) and len(g):
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    np.cumsum(np.where(keys[at] == g, both[:, at], 0), 1, out=sums[:, 1:], dtype=np.float64)
                part = sums[:, t.bounds[1:]] - sums[:, t.bounds[:-1]]
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__text"), pa.array(np.diff(t.bounds)), pa.array(b.column("t").to_numpy() + part[0]), pa.array(b.column("b").to_numpy() + part[1])], names=[x.name for x in schema])

        out = out.mapInArrow(run, schema)
    for used in (table, ids):  # what the result needs of them has been sent out
        drop(used)
    n = F.nullif(F.col("n"), F.lit(0))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("t") / n).alias("target_loss"), (F.col("b") / n).alias("background_loss"), ((F.col("t") - F.col("b")) / n).alias("score"))
