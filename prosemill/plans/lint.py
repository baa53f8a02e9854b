"""Lint plans: prepare documents, run detectors, score, and compare with a baseline."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, mask_comments, mask_markdown, normal_lines, paragraphs_of, sentences_of, ustrip
from ..operators.detectors import FINDING, MORPHEMES, SURFACE
from ..rules.packs import EXPERIMENTAL, JA, PROFILES, Pack, Profile

#: Categories whose findings are the same whatever their excerpt.
WHOLE_DOCUMENT = ("low_burstiness", "high_length_autocorrelation", "low_sentence_variance", "uniform_paragraph_structure", "low_lexical_diversity_ttr", "low_lexical_diversity_mtld")
KEY_LENGTH = 20


def prepare(docs: DataFrame, pack: Pack = JA, id_col: str = "doc_id", text_col: str = "text", markdown: bool = True) -> DataFrame:
    """``doc_id``, ``text``, ``bare``, ``lines``, ``sentences`` and ``paragraphs`` of every document with a text; one narrow stage."""
    text = normal_lines(F.col(text_col))
    out = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    out = out.withColumn("masked", mask_markdown(F.col("text")) if markdown else F.col("text")).withColumn("bare", mask_comments(F.col("text")))
    out = out.withColumn("lines", F.expr(lines_of("text", "masked"))).drop("masked")
    return out.withColumn("sentences", F.expr(sentences_of("lines", pack.delimiters))).withColumn("paragraphs", F.expr(paragraphs_of("lines")))


def run_lint(prepared: DataFrame, pack: Pack = JA, genre: str | None = None, experimental: bool = False, profile: Profile | None = None, categories: Collection[str] | None = None) -> DataFrame:
    """One row per finding: ``doc_id``, ``ix`` (its place in the document) and the finding.

    Rules over morphemes run when ``prepared`` has a ``tokens`` column (and, for
    paragraphs, ``paragraph_tokens``). With ``categories`` only their rules are
    part of the plan, and ``ix`` counts their findings.
    """
    profile = profile or PROFILES[genre]
    rules = dict(SURFACE)
    if "tokens" in prepared.columns:
        rules |= {k: f for k, f in MORPHEMES.items() if k != "low_specificity" or "paragraph_tokens" in prepared.columns}
    hidden = set(profile.disabled) | (set() if experimental else set(EXPERIMENTAL))
    wanted = [f for k, f in rules.items() if k not in hidden and (categories is None or any(c.startswith(k) for c in categories))]
    if not wanted:
        wanted = [lambda *_: f"cast(array() as array<{FINDING}>)"]
    arrays = [F.expr(f"cast({f(pack, profile)} as array<{FINDING}>)") for f in wanted]
    found = F.flatten(F.array(*arrays))
    # stable by line: rules keep their order within one line
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct(x["line"].alias("line"), i.alias("ix"), x.alias("finding"))))
    rows = prepared.select("doc_id", F.posexplode(ordered).alias("ix", "x"))
    kept = ~F.col("category").isin(*hidden) if hidden else F.lit(True)
    return rows.select("doc_id", "ix", "x.finding.*").filter(kept if categories is None else kept & F.col("category").isin(*categories))


def fires(rule: str, pack: Pack = JA, genre: str | None = None) -> Column:
    """Whether a surface rule finds anything in a document of ``prepare``; for queries that keep its other documents, without a second pass and a join."""
    return F.expr(f"size({SURFACE[rule](pack, PROFILES[genre])}) > 0")


def rows_where(df: DataFrame, condition) -> DataFrame:
    """The rows that fulfil ``condition`` (of the row as a struct).

    A plain filter over computed columns is pushed below them and computes what it reads a second time.
    """
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), condition)))


def run_full_lint(prepared: DataFrame, pack: Pack = JA) -> DataFrame:
    """The pass that calibration counts: every rule, default thresholds, and structure read with comments in place."""
    return run_lint(prepared.withColumn("bare", F.col("text")), pack, experimental=True)


def find_line(lines: str, needle: str, hint: str = "0") -> str:
    """SQL: the first line from ``hint`` on that has the needle, else the first of all, else the hint or 1."""
    at = f"transform(filter({lines}, l -> contains(l.masked, {needle})), l -> l.no)"
    return f"coalesce(array_min(filter({at}, n -> n >= {hint})), array_min({at}), nullif({hint}, 0), 1)"


def clean_text(prepared: DataFrame, longest: int = 2000) -> DataFrame:
    """Prose lines of a document joined, cut to the length that external language models read."""
    kept = F.filter(F.transform("lines", lambda x: x["masked"]), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    return prepared.select("doc_id", F.substring(F.array_join(kept, "\n"), 1, longest).alias("text"))


def findings_json(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id): its findings as one JSON object, in their order, with counts by category; each has its ``status`` where there is one."""
    fields = ("line", "category", "excerpt", "severity", "detail", "related_lines", *(("status",) if "status" in findings.columns else ()))
    own = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", *fields))).alias("f"))
    kind = FINDING[:-1] + ",status:string>" if "status" in fields else FINDING
    listed = F.coalesce(F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in fields])), F.expr("array()").cast(f"array<{kind}>"))
    rows = docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", listed.alias("findings"))
    counts = F.expr("map_from_entries(transform(array_sort(array_distinct(transform(findings, x -> x.category))), c -> struct(c, size(filter(findings, x -> x.category = c)))))")
    return rows.select("doc_id", F.to_json(F.struct(F.size("findings").alias("count"), counts.alias("by_category"), "findings"), {"ignoreNullFields": "false"}).alias("json"))


def count_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def naturalness(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Score from 20 to 100 and band per document; none for texts of fewer than 100 characters.

    ``docs`` has doc_id and n_chars. Fixed values: penalties 8, 4 and 0.5 per
    1000 characters; bands from 90, 70 and 50.
    """
    weights = F.create_map(F.lit("critical"), F.lit(8.0), F.lit("warn"), F.lit(4.0), F.lit("info"), F.lit(0.5))
    sums = findings.groupBy("doc_id").agg(F.sum(weights[F.col("severity")]).alias("weight"))
    joined = docs.select("doc_id", "n_chars").join(sums, "doc_id", "left")
    score = F.greatest(100 - F.coalesce("weight", F.lit(0.0)) * 1000 / F.greatest("n_chars", F.lit(1000)), F.lit(20.0))
    out = joined.select("doc_id", "n_chars", F.when(F.col("n_chars") >= 100, score).alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 90, "natural").when(F.col("score") >= 70, "fair").when(F.col("score") >= 50, "stiff").when(F.col("score").isNotNull(), "machine-like"))


def identity_key(category, excerpt):
    """Findings are the same by category and the first characters of the excerpt without white space."""
    return F.when(category.isin(*WHOLE_DOCUMENT), "").otherwise(F.substring(F.regexp_replace(F.coalesce(excerpt, F.lit("")), r"(?U)\s+", ""), 1, KEY_LENGTH))


def valid_baseline(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Findings of baseline JSON texts: elements without a string category and excerpt are skipped and counted."""
    items = F.from_json(F.get_json_object(json_col, "$.findings"), "array<string>")
    item = F.col("item")
    quoted = lambda k: F.get_json_object(item, f"$.{k}")
    rows = raw.select("doc_id", F.posexplode_outer(items).alias("ix", "item"))
    return rows.select("doc_id", "ix", quoted("category").alias("category"), quoted("excerpt").alias("excerpt"), (quoted("category").isNotNull() & quoted("excerpt").isNotNull()).alias("valid"))


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiset difference: every finding with ``status`` new, persisting or resolved.

    Equal keys are paired one to one in order of ``ix``.
    """
    own = ("doc_id", "ix", "category", "excerpt")
    return diff_of_sides(findings.select(*own, F.lit(0).alias("side")).unionAll(baseline.select(*own, F.lit(1).alias("side"))))


def diff_of_sides(sides: DataFrame) -> DataFrame:
    """``baseline_diff`` of findings whose ``side`` is 0 (now) or 1 (the baseline), for two runs that one pass gives; without a category nothing is paired."""
    keyed = sides.select("doc_id", "ix", "category", "excerpt", "side", identity_key(F.col("category"), F.col("excerpt")).alias("key"))
    lone = F.when(F.col("category").isNull(), F.col("side"))
    numbered = keyed.withColumn("lone", lone).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "category", "key", "side").orderBy("ix")))
    pairs = numbered.groupBy("doc_id", "category", "key", "lone", "rn").agg(F.coalesce(F.min_by("excerpt", "side"), F.max_by("excerpt", "side")).alias("excerpt"), F.min("side").alias("first"), F.max("side").alias("last"))
    status = F.when(F.col("first") == 1, "resolved").when(F.col("last") == 0, "new").otherwise("persisting")
    return pairs.select("doc_id", "category", "excerpt", status.alias("status"))


__all__ = ["baseline_diff", "clean_text", "count_by_category", "diff_of_sides", "find_line", "findings_json", "fires", "identity_key", "naturalness", "prepare", "rows_where", "run_full_lint", "run_lint", "ustrip", "valid_baseline"]
