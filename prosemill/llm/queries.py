"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES
from .shared import dealt_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on, in as many partitions as there are cores at least."""
    return dealt_out(_table(spark, sf_dir, name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import codec, encode

    docs = _texts(spark, sf_dir, "documents")
    return encode(docs, codec(docs))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = _texts(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination_report

    return contamination_report(_texts(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_texts(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_texts(spark, sf_dir, "documents")).drop("matches")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import JoinRules, link_classes

    return link_classes(_texts(spark, sf_dir, "documents"), rules=JoinRules(percent=85))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_texts(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the documents labelled as good and not toxic."""
    from .lmscore import score_cross_entropy

    labels = _table(spark, sf_dir, "labels")
    return score_cross_entropy(_texts(spark, sf_dir, "documents"), labels.filter("quality = 1 and toxic = 0").select("doc_id"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the labelled document whose number ends its path: bad if of low quality or toxic."""
    from .urlfilter import judge_urls, path_of

    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    numbered = pages.select("page_id", F.try_to_number(F.nullif(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,15})[^0-9/]*/?$", 1), F.lit("")), F.lit("999999999999999")).cast("bigint").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlmain import extract_main_text

    return extract_main_text(_texts(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_cross_entropy": op6_cross_entropy,
    "op7_url_reputation": op7_url_reputation,
    "op8_licenses": op8_licenses,
    "op9_main_text": op9_main_text,
    "op10_near_duplicates": op10_near_duplicates,
}

__all__ = ["ORACLES", "QUERIES"]
