"""Text of reports: one string per document, made where its findings are, and Markdown of study results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import markdown_table


def lint_reports(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``doc_id``, ``report``: counts by category, the most frequent first, then every finding in its order; with ``status`` its place against a baseline."""
    status = F.col("status") if "status" in findings.columns else F.lit(None).cast("string")
    tag = F.when(status.isNotNull(), F.concat(F.lit("["), status, F.lit("] "))).otherwise("")
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n    "), F.col("detail"))).otherwise("")
    entry = F.concat(tag, F.lit("["), F.col("severity"), F.lit("] L"), F.col("line").cast("string"), F.lit(" ("), F.col("category"), F.lit(")\n    "), F.coalesce("excerpt", F.lit("")), detail)
    own = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", entry.alias("entry")))).alias("f"))
    counts = findings.groupBy("doc_id", "category").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))).alias("c"))
    rows = docs.select("doc_id").join(own, "doc_id", "left").join(counts, "doc_id", "left")
    head = F.concat(F.lit("=== lint: "), F.col("doc_id").cast("string"), F.lit(" ===\nfindings: "), F.coalesce(F.size("f"), F.lit(0)).cast("string"))
    by = F.array_join(F.transform("c", lambda x: F.concat(F.lit("\n  - "), x["category"], F.lit(": "), (-x["k"]).cast("string"))), "")
    listed = F.concat(F.lit("\n\n"), F.array_join(F.transform("f", lambda x: x["entry"]), "\n\n"))
    return rows.select("doc_id", F.concat(head, F.coalesce(by, F.lit("")), F.coalesce(listed, F.lit("\n\nnone"))).alias("report"))


def outline_reports(entries: DataFrame) -> DataFrame:
    """``doc_id``, ``report``: headings indented by level, with their leads and lists below."""
    depth = F.coalesce(F.col("level"), F.lit(1))
    text = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("  "), depth - 1), F.repeat(F.lit("#"), depth), F.lit(" "), F.col("text"))).otherwise(F.concat(F.lit("    "), F.col("text")))
    lines = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))).alias("x"))
    return lines.select("doc_id", F.array_join(F.transform("x", lambda e: F.concat(F.lit("L"), e["line"].cast("string"), F.lit(": "), e["t"])), "\n").alias("report"))


def term_reports(terms: DataFrame) -> DataFrame:
    """``doc_id``, ``report``: terms in order of first places with counts; `*` marks a hint at an explanation."""
    text = F.concat(F.lit("L"), F.col("first_line").cast("string"), F.lit(" "), F.col("term"), F.when(F.col("has_gloss_hint"), "*").otherwise(""), F.lit(" x"), F.col("count").cast("string"))
    own = terms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "place", text.alias("t")))).alias("x"))
    return own.select("doc_id", F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("report"))


def evaluation_report(losses: DataFrame, clusters: DataFrame, triggers: DataFrame | None = None, errors: DataFrame | None = None) -> str:
    """Markdown of an evaluation's results (a row per document type, place, set and failed item): for the driver, as they are small."""
    parts = [("Loss rates", losses), ("Issue clusters", clusters), ("Trigger accuracy", triggers), ("Failed items", errors)]
    return "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts if df is not None)


__all__ = ["evaluation_report", "lint_reports", "outline_reports", "term_reports"]
