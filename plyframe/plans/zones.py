"""A corpus in zones of its key, with a manifest, so that prefixes are found and rows numbered without sorting it again.

An appended table is range-partitioned by its key once; each range is a zone, written sorted, and the manifest keeps the zone's
least and largest key, its rows, and how many rows passed the caller's check with the number of the first of them. Tables
appended later take later zones: their rows come after all earlier ones, and numbers given once stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Check = Callable[[DataFrame], DataFrame]


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """zone, low, high, rows, valid, first (the number of its first valid row): a row for each zone; None for no corpus."""
    try:
        return spark.read.parquet(f"{folder}/manifest")
    except AnalysisException:
        return None


def append(docs: DataFrame, folder: str, key: str, check: Check, zone_rows: int = 1_000_000) -> None:
    """Add the rows of `docs` that `check` keeps, as it returns them, after the rows of the corpus in `folder`.

    `check` must keep the column `key`; rows without a key are left out. Zones have about `zone_rows` rows. The next zone and number come from the manifest, one
    aggregate of a row for each zone. Rows become visible with their manifest, which is written last: an append that fails
    leaves none that is read.
    """
    spark = docs.sparkSession
    known = manifest(spark, folder)
    zone, number = (0, 0) if known is None else known.agg(F.max("zone") + 1, F.coalesce(F.max(F.col("first") + F.col("valid")), F.lit(0))).first()
    zones = max(1, -(-docs.count() // zone_rows))
    rows = docs.repartitionByRange(zones, key).withColumn("_zone", F.spark_partition_id() + zone)
    target = f"{folder}/raw/from={zone}"
    rows.sortWithinPartitions(key).write.mode("overwrite").parquet(target)
    rows = spark.read.schema(rows.schema).parquet(target)
    spans = rows.groupBy("_zone").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    zone_of = rows.where(F.col(key).isNotNull()).select(key, "_zone").distinct()  # a range partitioning never parts equal keys
    placed = check(rows.drop("_zone")).join(zone_of, key)
    target = f"{folder}/valid/from={zone}"
    placed.repartition("_zone").sortWithinPartitions("_zone", key).write.mode("overwrite").parquet(target)
    counts = spark.read.schema(placed.schema).parquet(target).groupBy("_zone").agg(F.count("*").alias("valid"))
    before = Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # a row for each zone
    table = spans.join(counts, "_zone", "left").select(
        F.col("_zone").cast("long").alias("zone"), "low", "high", "rows", F.coalesce("valid", F.lit(0)).alias("valid"))
    table = table.withColumn("first", F.lit(number) + F.coalesce(F.sum("valid").over(before), F.lit(0)))
    table.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def numbered(spark: SparkSession, folder: str, key: str, first: int = 0, below: int | None = None) -> DataFrame:
    """The corpus' valid rows with their lasting number `ord`, from number `first` on and under `below`.

    Only zones that hold such numbers are read, chosen by a literal list or range of zones from the manifest; rows are numbered
    inside their zone, after the zone's first number.
    """
    known = manifest(spark, folder)
    if known is None:
        raise ValueError(f"no corpus in {folder}")
    held = (F.col("first") + F.col("valid") > first) & (F.col("valid") > 0)
    if below is not None:
        held = held & (F.col("first") < below)
    low, high = known.where(held).agg(F.min("zone"), F.max("zone")).first()
    rows = spark.read.parquet(f"{folder}/valid").drop("from").where(F.col("_zone").between(low if low is not None else 0, high if high is not None else -1))
    starts = known.select(F.col("zone").cast("int").alias("_zone"), F.col("first").alias("_first"))
    inside = Window.partitionBy("_zone").orderBy(key)
    out = rows.withColumn("_place", F.row_number().over(inside) - 1).join(starts, "_zone")
    out = out.withColumn("ord", F.col("_first") + F.col("_place")).drop("_zone", "_place", "_first").where(F.col("ord") >= first)
    return out if below is None else out.where(F.col("ord") < below)
