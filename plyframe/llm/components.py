"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.plans.scratch import apart, written


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links (a, b) that is not its own root.

    Large star and small star in turn until nothing changes: every node is tied to the smallest of its neighbours, so
    chains halve and the graph ends as stars. Minima are partial aggregates and the joins may split a node with many
    links; each round is written, so its lineage is one file.
    """
    edge = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now, seen = written(links.where("a <> b").select(*edge).distinct()), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(apart(least, "a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(least, "a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
