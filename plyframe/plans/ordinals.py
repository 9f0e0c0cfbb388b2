"""Dense row numbers without a single-partition window over the data.

Ordered numbers come from a range partitioning by the key: rows are sorted inside their partition and written with
their place in it, and a partition starts after the rows of the partitions before it. Any key will do, of any number
and type of columns, dense or sparse; no task holds more than a partition, which sorts on disk if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.plans.scratch import written

SUPER_BITS = 10
PLACE = (1 << 33) - 1  # of a row in its partition, in the ids that Spark gives out


def dense_ordinal(df: DataFrame, key: str | list[str], group: list[str] | None = None, below: int | None = None,
                  out: str = "ord") -> DataFrame:
    """Number rows 0, 1, 2, ... by the columns `key`, nulls first, separately per group.

    Rows that are equal in group and key get numbers in any order. With `below` only rows numbered under it are
    returned. `df` is read twice, for the bounds of the ranges and for the rows.
    """
    group, key = group or [], [key] if isinstance(key, str) else key
    rows = df.repartitionByRange(*group, *key).sortWithinPartitions(*group, *key).withColumns(
        {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))})
    rows = written(rows)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_place"))
    if group:
        first = written(rows.groupBy(*group).agg(F.min(out).alias("_first")))
        same = [rows[g].eqNullSafe(first[g]) for g in group]
        rows = rows.join(first, same).select(*(rows[c] for c in df.columns), (F.col(out) - F.col("_first")).alias(out))
    rows = rows.drop("_part", "_place", "_start")
    return rows if below is None else rows.where(F.col(out) < below)


def cyclic_next(df: DataFrame, key: str, group: list[str], out: str = "next") -> DataFrame:
    """The next key in the group, the first one after the last, by an equality join on the numbers of the rows."""
    rows = written(dense_ordinal(df, key, group, out="_ord"))
    last = written(rows.groupBy(*group).agg(F.max("_ord").alias("_last")))
    inner = rows.where("_ord > 0").select(*group, (F.col("_ord") - 1).alias("_ord"), F.col(key).alias(out))
    first = rows.where("_ord = 0").join(last, group).select(*group, F.col("_last").alias("_ord"), F.col(key).alias(out))
    return rows.join(inner.union(first), [*group, "_ord"]).select(*df.columns, out)


def gapless(df: DataFrame, group: list[str], parts: Column, row: str, out: str = "slot") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in no particular order, whatever keys they have.

    `row` is a number of its own for each row, the same in every pass, as a table has that was written with it. Rows are
    dealt by its hash to `parts` buckets of their group, a count that follows the group's size; a bucket starts after
    the rows of the buckets before it. No window holds more than one bucket, however large a group is.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(row), parts.cast("long")))
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_super", F.shiftright("_part", SUPER_BITS))
    supers = counts.groupBy(*group, "_super").agg(F.sum("_rows").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(*group, "_super", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_super").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(supers, [*group, "_super"]).select(
        *group, "_part", (F.col("_base") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_start"))
    within = Window.partitionBy(*group, "_part").orderBy(row)
    numbered = dealt.withColumn("_place", F.row_number().over(within) - 1)
    return (numbered.join(starts, [*group, "_part"])
            .withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place"))
