"""Threshold sweeps of the detectors: one value per document and detector, and its rates over a fixed grid.

A detector fires at a threshold as a comparison of one value of the document with
it, so the detectors themselves never run again: a row counts how many thresholds
of its grid fire, and the curve is a sum over those counts.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, quoted, ustrip
from ..operators import detectors as D
from ..rules import packs
from ..rules.packs import DEFAULT, Pack, Profile

Value = Callable[[Pack, Profile], str]


def _steps(low: float, high: float, step: float) -> list[float]:
    return [round(float(low + k * step), 6) for k in range(round((high - low) / step) + 1)]


def _burstiness(_: Pack, p: Profile) -> str:
    return let(D.moments(D.mora_lengths()), "s", f"if(s.n >= {p.burstiness_min} and s.sd + s.mean > 0, (s.sd - s.mean) / (s.sd + s.mean), null)")


def _autocorrelation(_: Pack, p: Profile) -> str:
    return f"if(size(tokens) >= {p.burstiness_min} and size(tokens) - 1 >= {p.autocorrelation_min}, {D.correlation(D.mora_lengths())}, null)"


def _variance(_: Pack, p: Profile) -> str:
    return let(D.moments("transform(sentences, x -> length(x.masked))"), "s", f"if(s.n >= {p.variance_min_sentences}, s.sd / nullif(s.mean, 0D), null)")


def _nominal(_: Pack, p: Profile) -> str:
    count = f"size(filter(tokens, t -> coalesce({D.last_pos('t.morphemes')} = '名詞', false)))"
    return f"if(size(tokens) >= {p.nominal_min_sentences} and length(text) >= {p.nominal_min_chars}, {count} / size(tokens), null)"


def _leads(pack: Pack, p: Profile) -> str:
    hits = f"size(filter(paragraphs, g -> exists({D.words(pack.conjunctions)}, c -> startswith({ustrip('g[0].masked')}, c))))"
    return let(hits, "h", f"if(size(paragraphs) >= {p.conjunction_min_paragraphs} and h > 0, h / size(paragraphs), null)")


def _uniform(pack: Pack, p: Profile) -> str:
    return let(D.moments(D.paragraph_counts(pack)), "s", f"if(s.n >= {p.uniform_min_paragraphs}, coalesce(s.sd / nullif(s.mean, 0D), 0D), null)")


def _antithesis(pack: Pack, _: Profile) -> str:
    return f"aggregate(lines, 0, (a, l) -> a + {' + '.join(f'regexp_count(l.masked, {quoted(x)})' for x in pack.antithesis) or '0'})"


def _most(keys: str) -> str:
    return f"aggregate(array_sort({keys}), struct('' as w, 0 as c, 0 as most), (a, x) -> if(x = a.w, struct(x as w, a.c + 1 as c, greatest(a.most, a.c + 1) as most), struct(x as w, 1 as c, greatest(a.most, 1) as most))).most"


def _lead_repeats(_: Pack, __: Profile) -> str:
    return _most("transform(filter(tokens, t -> size(t.morphemes) >= 2), t -> concat(t.morphemes[0].surface, t.morphemes[1].surface))")


def _templates(_: Pack, p: Profile) -> str:
    tags = "transform(filter(tokens, t -> size(t.morphemes) >= 4), t -> array_join(transform(slice(t.morphemes, 1, 4), m -> m.pos0), '/'))"
    return let(tags, "g", f"if(size(g) >= {p.template_min}, {_most('g')} / size(g), null)")


def _diversity(value: str) -> Value:
    content = f"transform(filter(flatten(transform(tokens, t -> t.morphemes)), m -> m.pos0 in {packs.CONTENT_POS}), m -> m.dict_form)"
    return lambda _, p: let(content, "c", f"if(length(text) >= {p.diversity_min_chars} and size(c) >= {p.diversity_min_tokens}, {value}, null)")


def _specificity(_: Pack, p: Profile) -> str:
    return f"array_min(filter(transform(paragraph_tokens, g -> {D.specificity_score(p)}), x -> x is not null))"


#: The value of each detector, the grid of its thresholds, and how it fires.
SWEEPS: dict[str, tuple[Value, list[float], str]] = {
    "low_burstiness": (_burstiness, _steps(-0.9, -0.2, 0.02), "lt"),
    "high_length_autocorrelation": (_autocorrelation, _steps(0.1, 0.95, 0.05), "gt"),
    "low_sentence_variance": (_variance, _steps(0.05, 0.6, 0.02), "lt"),
    "nominal_ending": (_nominal, _steps(0.05, 0.6, 0.02), "le"),
    "paragraph_lead_conjunction": (_leads, _steps(0.05, 0.7, 0.02), "ge"),
    "uniform_paragraph_structure": (_uniform, _steps(0.02, 0.5, 0.02), "lt"),
    "antithesis_repetition": (_antithesis, _steps(1, 8, 1), "ge"),
    "repeated_sentence_lead": (_lead_repeats, _steps(1, 8, 1), "ge"),
    "repeated_syntax_template": (_templates, _steps(0.1, 0.9, 0.05), "ge"),
    "low_lexical_diversity_ttr": (_diversity("size(array_distinct(c)) / size(c)"), _steps(0.2, 0.7, 0.02), "lt"),
    "low_lexical_diversity_mtld": (_diversity(D.mtld("c")), _steps(10, 90, 2), "lt"),
    "low_specificity": (_specificity, _steps(-0.3, 0.6, 0.02), "lt"),
}


def detector_values(prepared: DataFrame, pack: Pack, profile: Profile = DEFAULT, detectors: Collection[str] | None = None) -> DataFrame:
    """``doc_id``, ``metric`` and ``value`` of every detector (null where it cannot fire), from documents with ``tokens`` and ``paragraph_tokens``."""
    wanted = [k for k in SWEEPS if detectors is None or k in detectors]
    each = ", ".join(f"struct('{k}' as metric, cast({SWEEPS[k][0](pack, profile)} as double) as value)" for k in wanted)
    return prepared.select("doc_id", F.inline(F.expr(f"array({each})")))


def sweep_detectors(values: DataFrame, max_fp: float = 0.05) -> DataFrame:
    """From (metric, value, is_base): rates at every threshold of each metric's grid, and the recommended one.

    That is the highest detection with a false-positive rate under ``max_fp``, of ties the first of the grid.
    """
    grid = [(k, i, t, len(g), op in ("lt", "le"), op in ("lt", "gt")) for k, (_, g, op) in SWEEPS.items() for i, t in enumerate(g)]
    spark = values.sparkSession
    rows = spark.createDataFrame(grid, "metric string, ix int, threshold double, size int, below boolean, strict boolean")
    grids = rows.groupBy("metric").agg(F.max("below").alias("below"), F.max("strict").alias("strict"), F.collect_list("threshold").alias("grid"))
    sign = F.when(F.col("below"), -1).otherwise(1)
    x = sign * F.col("value")
    fires = F.filter("grid", lambda t: F.when(F.col("strict"), x > sign * t).otherwise(x >= sign * t))
    counted = values.join(F.broadcast(grids), "metric").select("metric", "is_base", F.coalesce(F.when(F.col("value").isNotNull(), F.size(fires)), F.lit(0)).alias("p"))  # a dozen grids
    counts = counted.groupBy("metric", "p").agg(F.count_if("is_base").alias("b"), F.count_if(~F.col("is_base")).alias("a"))
    # one array of counts for each metric, as a second use of them would run the detectors again
    own = counts.groupBy("metric").agg(F.sum("b").alias("nb"), F.sum("a").alias("na"), F.collect_list(F.struct("p", "b", "a")).alias("c"))
    place = rows.withColumn("k", F.when(F.col("below"), F.col("size") - F.col("ix")).otherwise(F.col("ix") + 1))
    # a row that fires at p thresholds fires at the p most permissive ones
    fired = lambda x: F.aggregate(F.filter("c", lambda y: y["p"] >= F.col("k")), F.lit(0).cast("bigint"), lambda s, y: s + y[x])
    curve = place.join(own, "metric").select("metric", "ix", "threshold", "nb", "na", fired("b").alias("fp"), fired("a").alias("hit"))
    rate = lambda c, n: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), n), F.lit(0.0))
    rated = curve.select("metric", "ix", "threshold", rate(F.col("fp"), F.col("nb")).alias("fp_rate"), rate(F.col("hit"), F.col("na")).alias("hit_rate"))
    best = F.row_number().over(Window.partitionBy("metric").orderBy(F.when(F.col("fp_rate") < max_fp, 0).otherwise(1), F.col("hit_rate").desc(), "ix"))
    return rated.withColumn("recommended", (best == 1) & (F.col("fp_rate") < max_fp)).select("metric", "threshold", "fp_rate", "hit_rate", "recommended")


__all__ = ["SWEEPS", "detector_values", "sweep_detectors"]
