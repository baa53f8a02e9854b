"""The training-corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import decontam, langid, neardup, quality, spm
from prosemill.llm.shared import dealt_out, drop, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; repeated rows stay or go together; a null id and other columns pass through.
    """
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the network learns from the labels of this stage's own input.

    Texts without a letter go, and all go where no row is labelled; rows without a label or an id are judged, never learned from.
    """
    return langid.filter_languages(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class.

    Texts without words are no copies of each other; rows without an id stay; of rows equal in id and text one stays.
    """
    return neardup.filter_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, items without a text have no passage, items without an id count; an empty benchmark removes nothing.
    """
    return decontam.filter_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, counts, digests and the decoding check of the remaining documents; a null text has null ids."""
    return spm.encode(docs, spm.codec(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot express the trained network or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = dealt_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
