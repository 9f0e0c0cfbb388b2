"""Rank correlation by counts of pairs, without comparing rows with rows and without a window over all of them.

Two different ranks differ first, from the top, in one bit: there the smaller has 0 and the larger 1, and above it both
have the same prefix. So every two rows with different x meet in one group (bit, prefix), on opposite sides; of them those are
discordant whose y goes the other way. Groups are summed by y before anything is compared and cut into slices of y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written

SLICE_BITS = 16
WIDE = "decimal(38,0)"


def rank_correlation(rows: DataFrame, x: str, y: str, *by: str, slice_bits: int = SLICE_BITS) -> DataFrame:
    """`by`, n, concordant, discordant, correlation: Kendall's tau-b of two columns, null without pairs that differ in x and
    in y. Rows with a null take no part; equal values are ties.

    Rows are reduced to their distinct (x, y) first. A window holds the distinct y of a slice, at most 2^`slice_bits`, or a
    row for each slice; counts of pairs are decimals, as they pass 64 bits.
    """
    by = list(by)
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    cells = written(cells.agg(F.count("*").alias("_n")))
    ranked = cells
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        places = dense_ordinal(cells.select(*by, value).distinct(), value, by, out=rank)
        same = [ranked[c].eqNullSafe(places[c]) for c in (*by, value)]
        ranked = ranked.join(places, same).select(*(ranked[c] for c in ranked.columns), places[rank])
    ranked = written(ranked)
    levels = int(ranked.agg(F.max("_rx")).first()[0] or 0).bit_length()

    group = [*by, "_bit", "_prefix"]
    sides = ranked.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)) if levels else F.array().cast("array<int>")))
    sides = sides.select(*by, "_bit", F.expr("shiftright(_rx, _bit + 1)").alias("_prefix"), F.expr("shiftright(_rx, _bit) & 1 = 1").alias("_upper"),
                         F.shiftright("_ry", slice_bits).alias("_slice"), "_ry", "_n")
    sums = [F.sum(F.when(F.col("_upper") == side, F.col("_n")).otherwise(0)).alias(name) for side, name in ((False, "_low"), (True, "_up"))]
    held = sides.groupBy(*group, "_slice", "_ry").agg(*sums)

    def against(table: DataFrame, within: list[str], order: str) -> DataFrame:
        """Pairs of a lower x and an upper x whose y comes before in `order`."""
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        under = table.withColumn("_under", F.sum("_up").over(before))
        return under.groupBy(*by).agg(F.sum(F.col("_low").cast(WIDE) * F.col("_under").cast(WIDE)).cast(WIDE).alias("value"))

    whole = held.groupBy(*group, "_slice").agg(F.sum("_low").alias("_low"), F.sum("_up").alias("_up"))
    parts = [against(held, [*group, "_slice"], "_ry").withColumn("kind", F.lit("d")), against(whole, group, "_slice").withColumn("kind", F.lit("d"))]
    for kind, of in (("all", []), ("x", ["_x"]), ("y", ["_y"]), ("both", ["_x", "_y"])):
        sizes = cells.groupBy(*by, *of).agg(F.sum("_n").alias("_n"))
        parts.append(sizes.groupBy(*by).agg(F.sum(_pairs(F.col("_n"))).cast(WIDE).alias("value")).withColumn("kind", F.lit(kind)))
    parts.append(cells.groupBy(*by).agg(F.sum("_n").cast(WIDE).alias("value")).withColumn("kind", F.lit("n")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    zero = F.lit(0).cast(WIDE)
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))).cast(WIDE), zero).alias(f"_{k}") for k in ("n", "all", "x", "y", "both", "d")]
    table = table.groupBy(*by).agg(*kinds)
    agree = (F.col("_all") - F.col("_x") - F.col("_y") + F.col("_both") - F.col("_d")).cast(WIDE)
    spread = F.sqrt((F.col("_all") - F.col("_x")).cast("double")) * F.sqrt((F.col("_all") - F.col("_y")).cast("double"))
    return table.where("_n > 0").select(
        *by, F.col("_n").cast("long").alias("n"), agree.alias("concordant"), F.col("_d").alias("discordant"),
        F.try_divide((agree - F.col("_d")).cast("double"), spread).alias("correlation"))


def _pairs(n: Column) -> Column:
    return (n.cast(WIDE) * (n - 1).cast(WIDE) / 2).cast(WIDE)
