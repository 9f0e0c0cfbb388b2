"""Where intermediate tables go: a fresh folder that the driver and every executor reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder of the session, or under its warehouse where that is unset: both are
    shared by the driver and the executors."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/plyframe-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once and read back: a lost executor costs a read of the file, not the plan above it."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def apart(df: DataFrame, key: str) -> DataFrame:
    """The rows of `df` without the partitioning by the whole number `key` that an aggregate left.

    A join with the table that was aggregated then shuffles both sides, and the adaptive join splits a key that many
    rows have. Joined in place, the rows of such a key would stay in the one task that holds its total.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))
