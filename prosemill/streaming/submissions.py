"""Streaming intake of reader-study submissions: validated, one per participant, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.study import SUBMISSION, valid_submission


def read_submissions(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of JSON-line files; no field beyond the schema, such as an address, is read."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", max_files).json(path)


def accepted(stream: DataFrame) -> DataFrame:
    """Well-formed submissions, the first of each participant.

    State is one key per participant; it is not bounded by a watermark, as a
    second submission must be refused however late it comes.
    """
    return stream.filter(valid_submission()).dropDuplicates(["participant_id"])


def append(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append accepted submissions to Parquet, each exactly once."""
    writer = accepted(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def admitted(known: DataFrame, incoming: DataFrame, order: str = "received_at") -> tuple[DataFrame, DataFrame]:
    """Batch twin with refusals: (accepted, rejected with ``reason`` malformed or duplicate) of ``incoming`` against participants ``known``."""
    rank = F.row_number().over(Window.partitionBy("participant_id").orderBy(order))
    good = incoming.filter(valid_submission()).withColumn("__rank", rank)
    seen = good.join(known.select("participant_id").distinct().withColumn("__seen", F.lit(True)), "participant_id", "left")
    fresh = F.col("__seen").isNull() & (F.col("__rank") == 1)
    refused = seen.filter(~fresh).select(*incoming.columns, F.lit("duplicate").alias("reason"))
    return seen.filter(fresh).select(*incoming.columns), incoming.filter(~valid_submission()).withColumn("reason", F.lit("malformed")).unionByName(refused)


def latest_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """Batch twin of the stream's rule: the first row of each key by ``order``."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), order).alias("x")).select(key, "x.*")
