"""Replies as a stream. Parsing is row-local, so the batch operator is used unchanged; samples are
a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyframe.operators.scoring import evaluate_replies

REPLY_SCHEMA = "model STRING, id BIGINT, full_reply STRING"


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files of replies, picked up as they appear in the folder."""
    return spark.readStream.schema(REPLY_SCHEMA).json(folder)


def score_stream(replies: DataFrame, samples: DataFrame, use_marker: bool = True, positioned: bool = False) -> DataFrame:
    """Scored replies of a stream; same columns as the batch result. Each batch reads the samples again; `positioned` as in
    `evaluate_replies` saves it reading their FENs."""
    return evaluate_replies(samples, replies, use_marker, positioned)
