"""Entries by their rank: an index of counts in two levels over ordered buckets, so that a page reads a bucket.

The table is sorted into buckets once, a folder each. Counts are kept for each bucket and group, and for each run of FAN
buckets; rank i is found in the runs, then in the buckets of one run, then among the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAN = 1024


def write_rank_index(rows: DataFrame, folder: str, key: str, group: list[str], bucket_rows: int = 1_000_000) -> None:
    """Sort `rows` by group and key into buckets of about `bucket_rows` rows and count them. The counts are written last."""
    spark = rows.sparkSession
    buckets = max(1, -(-rows.count() // bucket_rows))
    placed = rows.repartitionByRange(buckets, *group, key).withColumn("_bucket", F.spark_partition_id())
    placed.sortWithinPartitions(*group, key).write.partitionBy("_bucket").parquet(f"{folder}/rows")
    schema = placed.schema
    counts = spark.read.schema(schema).parquet(f"{folder}/rows").groupBy(*group, "_bucket").agg(F.count("*").alias("rows"))
    counts.withColumn("_run", F.floor(F.col("_bucket") / FAN)).write.partitionBy("_run").parquet(f"{folder}/buckets")
    counts = spark.read.parquet(f"{folder}/buckets")
    counts.groupBy(*group, "_run").agg(F.sum("rows").alias("rows")).write.parquet(f"{folder}/runs")


def entries_at(spark: SparkSession, folder: str, index: int, key: str, group: list[str]) -> DataFrame:
    """Row number `index` (from 0, in the order of `key`) of each group that has so many; rows of equal keys in any order.

    Only the buckets that hold such a row are read: their numbers, one for each group at most, come to the driver. Groups are
    few, as models or files are.
    """
    def holding(counts: DataFrame, within: list[str], order: str, at) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        start = counts.withColumn("_from", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        return start.where((F.col("_from") <= at) & (at < F.col("_from") + F.col("rows")))

    runs = holding(spark.read.parquet(f"{folder}/runs"), group, "_run", F.lit(index)).select(*group, "_run", F.col("_from").alias("_run_from"))
    inside = spark.read.parquet(f"{folder}/buckets").join(F.broadcast(runs), [*group, "_run"])
    found = holding(inside, [*group, "_run"], "_bucket", F.lit(index) - F.col("_run_from"))
    found = found.select(*group, "_bucket", (F.lit(index) - F.col("_run_from") - F.col("_from")).alias("_place"))
    base = f"{folder}/rows"
    numbers = sorted(r[0] for r in found.select("_bucket").distinct().collect())
    if not numbers:
        return spark.read.parquet(base).drop("_bucket").limit(0)
    rows = spark.read.option("basePath", base).parquet(*(f"{base}/_bucket={b}" for b in numbers))
    inner = Window.partitionBy(*group, "_bucket").orderBy(key)  # a bucket's rows
    placed = rows.join(F.broadcast(found), [*group, "_bucket"]).withColumn("_at", F.row_number().over(inner) - 1)
    return placed.where("_at = _place").select(*(c for c in rows.columns if c != "_bucket"))
