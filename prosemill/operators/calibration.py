"""Calibration: fire rates, threshold sweeps, length bins and rank statistics.

Detectors are never run again for a threshold: a metric is computed once for
each document, and sweeps are running counts over its distinct values.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length bins by their lower bounds.
LENGTH_BINS = (0, 1000, 2000, 4000)


def _categories(findings: DataFrame) -> Column:
    """The categories that occur, as one array: a scalar subquery, bounded by the rules there are."""
    return findings.agg(F.collect_set("category").alias("c")).scalar()


def fire_rates(docs: DataFrame, findings: DataFrame, group: str = "grp") -> DataFrame:
    """Category by group: share of documents with a finding, and findings per 1000 characters.

    ``docs`` has doc_id, the group and n_chars; ``findings`` doc_id and category.
    Every category appears for every group, with zeros where nothing fired.
    """
    totals = docs.groupBy(group).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    hits = findings.groupBy("doc_id", "category").agg(F.count("*").alias("hits")).join(docs.select("doc_id", group), "doc_id").groupBy("category", group).agg(F.count("*").alias("fired"), F.sum("hits").alias("hits"))
    grid = totals.withColumn("category", F.explode(_categories(findings)))
    out = grid.join(hits, ["category", group], "left")
    rate = lambda a, b: F.try_divide(F.coalesce(a, F.lit(0)), b)
    return out.select("category", group, "docs", F.coalesce("fired", F.lit(0)).alias("fired"), rate(F.col("fired"), F.col("docs")).alias("fire_rate"), rate(F.col("hits") * 1000, F.nullif("chars", F.lit(0))).alias("per_1000"))


def grid_sweep(metrics: DataFrame, grid: list[float], fires: str = "ge", max_fp: float = 0.05) -> DataFrame:
    """For every threshold of ``grid``: false-positive and detection rates, and the recommended one.

    ``metrics`` has value (null never fires) and is_base (trusted) or not. The
    recommendation is the highest detection with a false-positive rate under
    ``max_fp``; of ties the first of the grid.
    """
    op = {"ge": lambda v, t: v >= t, "le": lambda v, t: v <= t, "gt": lambda v, t: v > t, "lt": lambda v, t: v < t}[fires]
    sums = [F.count_if(F.col("is_base") & op(F.col("value"), F.lit(t))).alias(f"b{k}") for k, t in enumerate(grid)] + [F.count_if(~F.col("is_base") & op(F.col("value"), F.lit(t))).alias(f"a{k}") for k, t in enumerate(grid)]
    row = metrics.agg(F.count_if("is_base").alias("nb"), F.count_if(~F.col("is_base")).alias("na"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ix"), F.lit(float(t)).alias("threshold"), F.col(f"b{k}").alias("fp"), F.col(f"a{k}").alias("hit")) for k, t in enumerate(grid)]))
    curve = row.select("nb", "na", each.alias("x")).select("x.ix", "x.threshold", F.try_divide("x.fp", "nb").alias("fp_rate"), F.try_divide("x.hit", "na").alias("hit_rate"))
    best = F.row_number().over(Window.orderBy(F.when(F.col("fp_rate") < max_fp, 0).otherwise(1), F.col("hit_rate").desc_nulls_last(), "ix"))  # a row per grid value
    return curve.withColumn("recommended", (best == 1) & (F.col("fp_rate") < max_fp)).select("threshold", "fp_rate", "hit_rate", "recommended")


def exhaustive_sweep(metrics: DataFrame, key: str = "metric", max_fp: float = 0.05, bands: bool = False, kinds: tuple[str, ...] = ("ge", "le")) -> DataFrame:
    """The best threshold per metric over all observed values, in both directions and, with ``bands``, outside the median ± a distance.

    Input: key, value, is_base. Counts per distinct value come first; running
    sums over them, in windows by key, give every candidate's rates.
    """
    known = metrics.filter("value is not null")
    n = known.groupBy(key).agg(F.count_if("is_base").alias("nb"), F.count_if(~F.col("is_base")).alias("na"), F.median("value").alias("mid"))

    def candidates(df: DataFrame, kind: str, order: int) -> DataFrame:
        counts = df.groupBy(key, "value").agg(F.count_if("is_base").alias("b"), F.count_if(~F.col("is_base")).alias("a"))
        w = Window.partitionBy(key).orderBy(F.col("value").desc() if kind != "le" else F.col("value").asc()).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(key, F.col("value").alias("threshold"), F.lit(kind).alias("direction"), F.lit(order).alias("ord"), F.sum("b").over(w).alias("fp"), F.sum("a").over(w).alias("hit"))

    found = candidates(known, kinds[0], 0)
    for k, kind in enumerate(kinds[1:], 1):
        found = found.unionByName(candidates(known, kind, k))
    if bands:
        found = found.unionByName(candidates(known.join(n.select(key, "mid"), key).withColumn("value", F.abs(F.col("value") - F.col("mid"))), "band", 2))
    rated = found.join(n, key).select(key, "threshold", "direction", "ord", F.coalesce(F.try_divide("fp", "nb"), F.lit(0.0)).alias("fp_rate"), F.coalesce(F.try_divide("hit", "na"), F.lit(0.0)).alias("hit_rate"))
    # strict improvement: the first candidate by band, value and direction wins ties
    best = F.min_by(F.struct("threshold", "direction", "fp_rate", "hit_rate"), F.struct((-F.col("hit_rate")).alias("r"), (F.col("ord") == 2).alias("k"), F.col("threshold"), F.col("ord")))
    return rated.filter(F.col("fp_rate") < max_fp).groupBy(key).agg(best.alias("x")).select(key, "x.*")


def length_bin(chars: Column) -> Column:
    out = F.lit(len(LENGTH_BINS) - 1)
    for k in range(len(LENGTH_BINS) - 1, 0, -1):
        out = F.when(chars < LENGTH_BINS[k], k - 1).otherwise(out)
    return out


def length_analysis(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per category and length bin: documents and fired ones, for human and machine texts (``is_ai``), with the first effective bin."""
    binned = docs.select("doc_id", "is_ai", length_bin(F.col("n_chars")).alias("bin"))
    totals = binned.groupBy("bin").agg(F.count_if(~F.col("is_ai")).alias("human_docs"), F.count_if("is_ai").alias("ai_docs"))
    fired = findings.select("doc_id", "category").distinct().join(binned, "doc_id").groupBy("category", "bin").agg(F.count_if(~F.col("is_ai")).alias("human_fired"), F.count_if("is_ai").alias("ai_fired"))
    grid = totals.withColumn("category", F.explode(_categories(findings))).join(fired, ["category", "bin"], "left").fillna(0, ["human_fired", "ai_fired"])
    better = F.try_divide("ai_fired", "ai_docs") > F.try_divide("human_fired", "human_docs")
    return grid.withColumn("effective_from", F.min(F.when(better, F.col("bin"))).over(Window.partitionBy("category")))


def rank_statistics(values: DataFrame, key: str = "metric") -> DataFrame:
    """Per key: sizes, Cliff's delta, AUC, Mann-Whitney U and its two-sided p: exact for small samples without ties, else normal with tie correction.

    Input: key, value, is_ai. Ties are counted per distinct value, so ranks need
    no pair of rows: a running count over distinct values gives mid-ranks.
    """
    counts = values.filter("value is not null").groupBy(key, "value").agg(F.count_if("is_ai").alias("a"), F.count_if(~F.col("is_ai")).alias("h"))
    before = Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("a") + F.col("h")
    ranked = counts.select(key, "a", "h", (F.coalesce(F.sum(t).over(before), F.lit(0)) + (t + 1) / 2).alias("rank"), (t * t * t - t).cast("double").alias("tie"))
    sums = ranked.groupBy(key).agg(F.sum("a").alias("n_ai"), F.sum("h").alias("n_human"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("tie").alias("tie")).filter("n_ai > 0 and n_human > 0")
    m, n = F.col("n_ai").cast("double"), F.col("n_human").cast("double")
    u = F.col("r") - m * (m + 1) / 2
    total = m + n
    sd = F.sqrt(m * n / 12 * (total + 1 - F.col("tie") / F.greatest(total * (total - 1), F.lit(1.0))))
    z = F.greatest(F.abs(F.col("u") - m * n / 2) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    out = sums.withColumn("u", u)
    exact = (F.least("n_ai", "n_human") <= EXACT_BELOW) & (F.col("tie") == 0)
    p = F.when(exact, _exact_p()(F.when(exact, F.col("u")), F.col("n_ai"), F.col("n_human"))).otherwise(F.coalesce(normal_two_sided(z), F.lit(1.0)))
    return out.select(key, "n_ai", "n_human", "u", (2 * F.col("u") / (m * n) - 1).alias("cliffs_delta"), (F.col("u") / (m * n)).alias("auc"), p.alias("p"))


#: Fixed value: up to this size of the smaller sample p is exact, where no values tie.
EXACT_BELOW = 8


def exact_mann_whitney(u: float, m: int, n: int) -> float:
    """Two-sided p of U from its exact distribution, built as a quotient of polynomials."""
    m, n = min(m, n), max(m, n)
    counts = np.zeros(m * n + 1)
    counts[0] = 1
    for i in range(1, m + 1):
        if n + i <= m * n:
            counts[n + i :] -= counts[: -(n + i)].copy()
        for k in range(i):
            counts[k::i] = np.cumsum(counts[k::i])
    upper = max(u, m * n - u)
    return float(min(1.0, 2 * counts[int(np.ceil(upper - 1e-9)) :].sum() / counts.sum()))


def _exact_p():
    @F.pandas_udf("double")
    def p(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:  # a row per key, for small samples only
        return pd.Series([None if x is None or x != x else exact_mann_whitney(x, int(a), int(b)) for x, a, b in zip(u, m, n, strict=True)], dtype=float)

    return p


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p value by a rational approximation of the error function (error under 2e-7)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(poly * F.exp(-x * x), F.lit(1.0))


#: Ranges that a column of distinct values is cut into, so that no window holds all of them.
RANGES = 200


def _ranged(counts: DataFrame, value: str) -> DataFrame:
    """Adds ``__range``: values of a lower range are smaller. Cuts are approximate quantiles, so ranges are of like size."""
    cuts = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 2000)).first()[0] or []
    inside = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return counts.withColumn("__range", F.size(F.filter(inside, lambda c: c < F.col(value))))


def _running(ranged: DataFrame, value: str, what: Column, total, to: str, by: list[str], downward: bool = False) -> DataFrame:
    """Adds the running ``total`` (sum or min) of ``what`` up to each value, or down to it: within its range, and of the ranges before."""
    order = (lambda c: F.col(c).desc()) if downward else F.col
    own = total(what).over(Window.partitionBy(*by, "__range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0))
    whole = ranged.groupBy(*by, "__range").agg(total(what).alias("__t"))
    before = total("__t").over(Window.partitionBy(*by).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    joined = ranged.withColumn("__own", own).join(F.broadcast(whole.select(*by, "__range", before.alias("__before"))), [*by, "__range"])
    both = F.coalesce("__before", F.lit(0)) + F.col("__own") if total is F.sum else F.least("__before", "__own")
    return joined.withColumn(to, both).drop("__own", "__before")


def benjamini_hochberg(tests: DataFrame, family: str | None = None, p: str = "p") -> DataFrame:
    """Adds ``q``: the running minimum of p * n / rank from the largest p, at most 1; null for a null p.

    Tests are counted per distinct p, in ranges of it: equal p values have the rank of the last of them.
    """
    by = [family] if family else []
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__c"))
    ranked = _running(_ranged(counts, p), p, F.col("__c"), F.sum, "__rank", by)
    size = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    numbered = ranked.join(size, by) if by else ranked.withColumn("__n", F.lit(size.first()[0] or 0))
    scaled = numbered.withColumn("__scaled", F.col(p) * F.col("__n") / F.col("__rank"))
    adjusted = _running(scaled, p, F.col("__scaled"), F.min, "__q", by, downward=True).select(*by, p, F.least("__q", F.lit(1.0)).alias("q"))
    return tests.join(adjusted, [*by, p], "left").select(*tests.columns, "q")


def spearman(values: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns with mid-ranks, null when either is constant."""

    def ranks(df: DataFrame, c: str, to: str) -> DataFrame:
        n = df.groupBy(c).agg(F.count("*").alias("__t"))
        return _running(_ranged(n, c), c, F.col("__t"), F.sum, "__upto", []).select(c, (F.col("__upto") - (F.col("__t") - 1) / 2).alias(to))

    known = values.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    both = known.join(ranks(known, x, "rx"), x).join(ranks(known, y, "ry"), y)
    return both.agg(F.when((F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), F.corr("rx", "ry")).alias("rho"))


def describe(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def breakdown(values: DataFrame, threshold: float, *by: str, fires: str = "ge") -> DataFrame:
    """Count, mean and share at a threshold for each column of ``by`` alone and for all rows (nulls mark what is summed over)."""
    hit = F.col("value") >= threshold if fires == "ge" else F.col("value") <= threshold
    sets = [[F.col(c)] for c in by] + [[]]
    return values.filter("value is not null").groupingSets(sets, *by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(hit.cast("double")).alias("rate"))


def with_subgroups(docs: DataFrame, group: str = "grp", subgroup: str = "subgroup") -> DataFrame:
    """A row per group a document belongs to: its group, and its sub-group as a group of its own."""
    return docs.withColumn(group, F.explode(F.array_compact(F.array(F.col(group), F.col(subgroup)))))


def verdict(fp_rate: Column, hit_rate: Column, strong: float = 0.15) -> Column:
    """For a swept threshold: GO for a false-positive rate under .05 with a detection rate, or a gap between both, of ``strong``; else NO-GO."""
    return F.when((fp_rate < 0.05) & ((hit_rate - fp_rate >= strong) | (hit_rate >= strong)), "GO").otherwise("NO-GO")


#: Largest false-positive share that is still CONDITIONAL, by kind of count.
CONDITIONAL_BELOW = {"double_negation": 0.15, "redundant": 0.15, "notation": 0.3, "punctuation": 0.15}


def count_verdict(fp_share: Column, kind: str) -> Column:
    """For measures that only count: GO for a share of trusted documents with any under .05, CONDITIONAL below the limit of its kind, else NO-GO."""
    return F.when(fp_share < 0.05, "GO").when(fp_share < CONDITIONAL_BELOW[kind], "CONDITIONAL").otherwise("NO-GO")


#: Thresholds of a classifier's score.
SCORE_GRID = [round(0.05 * k, 2) for k in range(1, 20)]


def score_sweep(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """False-positive and detection rates of out-of-fold scores at the thresholds of ``SCORE_GRID``."""
    return grid_sweep(scored.select(F.col(score).alias("value"), (F.col(label) == 0).alias("is_base")), SCORE_GRID)


def rounded_sweep(metrics: DataFrame, digits: int = 1, max_fp: float = 0.05) -> DataFrame:
    """Both directions over thresholds that are observed values rounded to ``digits``: rates of every one, and the best of each direction.

    Input: value, is_base (both may hold for neither group: is_base null only lends its value). Counts per
    rounded and per own value come first; a value on the wrong side of its rounded threshold counts on its own side.
    """
    known = metrics.filter("value is not null")
    own = known.filter("is_base is not null").groupBy("value").agg(F.count_if("is_base").alias("b"), F.count_if(~F.col("is_base")).alias("a"))
    n = own.agg(F.sum("b").alias("nb"), F.sum("a").alias("na")).first()
    marks = known.select(F.round("value", digits).alias("value")).distinct().select("value", F.lit(0).alias("b"), F.lit(0).alias("a"), F.lit(True).alias("mark"))
    both = own.withColumn("mark", F.lit(False)).unionByName(marks).groupBy("value").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.max("mark").alias("mark"))
    ranged = _ranged(both, "value")
    out = None
    for direction, downward in (("low", False), ("high", True)):
        hits = _running(_running(ranged, "value", F.col("b"), F.sum, "fp", [], downward), "value", F.col("a"), F.sum, "hit", [], downward).filter("mark")
        rated = hits.select(F.lit(direction).alias("direction"), F.col("value").alias("threshold"), (F.col("fp") / F.lit(max(n.nb or 0, 1))).alias("fp_rate"), (F.col("hit") / F.lit(max(n.na or 0, 1))).alias("hit_rate"))
        out = rated if out is None else out.unionByName(rated)
    best = out.filter(F.col("fp_rate") < max_fp).groupBy("direction").agg(F.max_by("threshold", F.struct("hit_rate", -F.col("threshold"))).alias("best"))
    return out.join(best, "direction", "left").select("direction", "threshold", "fp_rate", "hit_rate", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False)).alias("recommended"))


def directed_sweep(metrics: DataFrame, direction: str = "auto", key: str = "metric", max_fp: float = 0.05) -> DataFrame:
    """The best threshold per metric in one direction (high or low); with ``auto`` in the better one, of equal ones high."""
    known = metrics.filter("value is not null")
    found = {d: exhaustive_sweep(known if d == "high" else known.withColumn("value", -F.col("value")), key, max_fp, kinds=("ge",)).withColumn("direction", F.lit(d)) for d in (("high", "low") if direction == "auto" else (direction,))}
    if "low" in found:
        found["low"] = found["low"].withColumn("threshold", -F.col("threshold"))
    both = found.popitem()[1]
    for other in found.values():
        both = both.unionByName(other)
    return both.groupBy(key).agg(F.min_by(F.struct("threshold", "direction", "fp_rate", "hit_rate"), F.struct((-F.col("hit_rate")).alias("r"), (F.col("direction") == "low").alias("d"))).alias("x")).select(key, "x.*")


def classifier_summary(scored: DataFrame, by: str | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Per group: AUC, and accuracy, recall and false-positive rate at .5."""
    keyed = scored.withColumn("__group", F.col(by).cast("string") if by else F.lit("all"))
    auc = rank_statistics(keyed.select(F.col("__group").alias("metric"), F.col(score).alias("value"), (F.col(label) == 1).alias("is_ai"))).select(F.col("metric").alias("__group"), "auc")
    said, true = F.col(score) >= 0.5, F.col(label) == 1
    out = keyed.groupBy("__group").agg(F.count("*").alias("n"), F.avg((said == true).cast("double")).alias("accuracy"), F.avg(F.when(true, said.cast("double"))).alias("recall"), F.avg(F.when(~true, said.cast("double"))).alias("fp_rate"))
    return out.join(auc, "__group", "left").select(F.col("__group").alias(by or "grp"), "n", "auc", "accuracy", "recall", "fp_rate")


def line_assignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of ``b`` for a cheapest one-to-one assignment of all of sorted ``a`` into sorted ``b`` (no shorter), by distance on the line.

    One sweep from left to right with two heaps: what a place would save by taking
    over the last point, and what a point pays to take a place or to send another
    back. Work is of the order of n log n and memory is linear.
    """
    far = float(abs(a).sum() + abs(b).sum() + 1) * 4 if len(a) else 0.0
    used = np.zeros(len(b), bool)
    points: list[tuple[float, int]] = []  # (cost of taking over a point, less the place's; place that becomes free or -1)
    places: list[tuple[float, int]] = []  # (cost of taking a place, less the point's; place that becomes used)
    order = np.argsort(np.concatenate((a, b)), kind="stable")
    for k in order.tolist():
        if k < len(a):
            x = float(a[k])
            cost, taken = heapq.heappop(places) if places else (far, -1)
            if taken >= 0:
                used[taken] = True
            heapq.heappush(points, (-2 * x - cost, taken))
        else:
            j = k - len(a)
            y = float(b[j])
            if points and points[0][0] + y < 0:
                cost, freed = heapq.heappop(points)
                used[j] = True
                if freed >= 0:
                    used[freed] = False
                    heapq.heappush(places, (-2 * y - cost, freed))
            else:
                heapq.heappush(places, (-y, j))
    return np.flatnonzero(used)


def matched_pairs(docs: DataFrame, value: str = "value", by: str = "genre") -> DataFrame:
    """Optimal one-to-one pairs of machine and human texts by length within each genre, with both values.

    Lengths are on a line, so the cheapest assignment keeps order: it is the choice
    of as many of the longer side as the shorter has, found in one sweep. A genre
    is one group of ids and lengths, of memory linear in its documents.
    """
    kind = docs.schema[by].dataType.simpleString()

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ai, human = (rows[rows.is_ai == side].assign(x=lambda d: np.log1p(d.n_chars)).sort_values(["x", "doc_id"]) for side in (True, False))
        if len(ai) <= len(human):
            human = human.iloc[line_assignment(ai.x.to_numpy(), human.x.to_numpy())]
        else:
            ai = ai.iloc[line_assignment(human.x.to_numpy(), ai.x.to_numpy())]
        return pd.DataFrame({by: pd.Series([key[0]] * len(ai), dtype=object), "ai_doc": ai.doc_id.to_numpy(), "human_doc": human.doc_id.to_numpy(), "ai_value": ai[value].to_numpy(float), "human_value": human[value].to_numpy(float)})

    rows = docs.filter(F.col(value).isNotNull()).select(by, "doc_id", "n_chars", "is_ai", value)
    return rows.groupBy(by).applyInPandas(pair, f"{by} {kind}, ai_doc bigint, human_doc bigint, ai_value double, human_value double")


def wilcoxon(pairs: DataFrame, key: str) -> DataFrame:
    """Signed-rank sums and normal p of paired differences per key; zero differences are left out."""
    d = pairs.select(key, (F.col("ai_value") - F.col("human_value")).alias("d")).filter("d <> 0")
    counts = d.groupBy(key, F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count("*").alias("t"))
    before = Window.partitionBy(key).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    s = ranked.groupBy(key).agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum(t * t * t - t).alias("tie"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    return s.select(key, "n", "w_plus", normal_two_sided(F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("p"))
