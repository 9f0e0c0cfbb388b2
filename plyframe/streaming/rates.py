"""Rates that follow a stream of replies, each counted once however often it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.operators.scoring import move_rates
from plyframe.streaming.replies import REPLY_SCHEMA, score_stream


def read_timed_replies(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON-lines files of replies with the time `at` they were given."""
    reader = spark.readStream.schema(f"{REPLY_SCHEMA}, at TIMESTAMP")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def running_rates(replies: DataFrame, samples: DataFrame, delay: str = "1 hour", use_marker: bool = True,
                  positioned: bool = False) -> DataFrame:
    """Rates by model of all replies so far, in update mode. A reply is known by model and id, and one that comes again up
    to `delay` after the latest is not counted again; the state is the replies of that time and a row for each model."""
    once = replies.withWatermark("at", delay).dropDuplicatesWithinWatermark(["model", "id"])
    return move_rates(score_stream(once, samples, use_marker, positioned), "model")


def keep_rates(rates: DataFrame, folder: str, checkpoint: str):
    """A writer that keeps each batch's changed rates in a folder of its own, which a repeated batch replaces."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def latest_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    values = F.struct(*(c for c in rows.columns if c not in ("model", "batch")))
    return rows.groupBy("model").agg(F.max_by(values, "batch").alias("_last")).select("model", "_last.*")
