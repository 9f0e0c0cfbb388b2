"""Totals of all subtrees by parallel tree contraction.

Every round compresses the runs of nodes with a single child and then rakes the leaves. A run is folded by doubling: its
nodes point at their child, then at the child's child, with the sum of what lies between, until all point at the node
below the run, which takes the parent of the run's top. Leaves give their sum to their parent and go. After compressing
no node has a single child, so a rake takes half of the nodes or more, and a tree of n nodes is gone after log n rounds
however deep it is. The rounds are then undone backwards: a folded node has the total of the node it points at and the sum on
the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.plans.scratch import written

SUMS = ("leaves", "total")


def _folded(chains: DataFrame) -> DataFrame:
    """The rows (node, below, and sums on the way) of nodes with a single child, pointing below their run."""
    while True:
        step = chains.select(F.col("node").alias("below"), F.col("below").alias("_next"), *(F.col(s).alias(f"_{s}") for s in SUMS))
        joined = chains.withColumn("again", F.lit(False)).join(step, "below", "left")
        chains = written(joined.withColumns({
            "below": F.coalesce("_next", "below"), "again": F.col("_next").isNotNull(),
            **{s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in SUMS}}).drop("_next", *(f"_{s}" for s in SUMS)))
        if chains.where("again").isEmpty():
            return chains


def subtree_totals(tree: DataFrame, value: str = "value") -> DataFrame:
    """node, children, leaves (childless nodes in the subtree, itself included), total (of `value` over the subtree).

    `tree` is a written table of node and parent, whole numbers that are their own, and a whole number `value`; roots have a
    null parent, and there may be several. Sums of children are partial aggregates, so one node may have most of the
    rows as its children. An empty table gives no rows.
    """
    zero = {f"edge_{s}": F.lit(0).cast("long") for s in SUMS}  # what the folded nodes above a node add to it
    alive = tree.select("node", F.col("parent"), F.lit(0).cast("long").alias("leaves"), F.col(value).cast("long").alias("total")).withColumns(zero)
    undo, children = [], None
    while True:
        own = F.min(F.struct("node", *zero)).alias("only")
        kids = alive.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), own)
        state = alive.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        if children is None:
            state = written(state.withColumn("leaves", (F.col("kids") == 0).cast("long")))
            children = state.select("node", F.col("kids").alias("children"))
        else:
            state = written(state)
        single = (F.col("kids") == 1) & F.col("parent").isNotNull()
        chains = state.where(single).select("node", "parent", *zero, F.col("only.node").alias("below"),
                                            *((F.col(s) + F.col(f"only.edge_{s}")).alias(s) for s in SUMS))
        kept = state.where(~single).drop("only")
        folded = None
        if not chains.isEmpty():
            inner = chains.select(F.col("below").alias("node"), F.lit(False).alias("top"))
            folded = _folded(written(chains.join(inner, "node", "left").withColumn("top", F.col("top").isNull())))
            tops = folded.where("top").select(F.col("below").alias("node"), F.col("parent").alias("_parent"),
                                              *((F.col(e) + F.col(s)).alias(f"_{e}") for s, e in zip(SUMS, zero, strict=True)))
            kept = written(kept.join(tops, "node", "left").select(
                "node", F.coalesce("_parent", "parent").alias("parent"), *SUMS, *(F.coalesce(f"_{e}", e).alias(e) for e in zero), "kids"))
        leaves = kept.where("kids = 0")
        undo.append((leaves.select("node", *SUMS), folded))
        given = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *(F.sum(F.col(s) + F.col(e)).alias(f"_{s}") for s, e in zip(SUMS, zero, strict=True)))
        inside = kept.where("kids > 0").join(given, "node", "left")
        alive = written(inside.select("node", "parent", *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in SUMS), *zero))
        if alive.isEmpty():
            break
    known = None
    for leaves, folded in reversed(undo):
        known = leaves if known is None else known.union(leaves)
        if folded is not None:
            below = known.select(F.col("node").alias("below"), *(F.col(s).alias(f"_{s}") for s in SUMS))
            more = folded.join(below, "below").select("node", *((F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS))
            known = written(known.union(more))
    return known.join(children, "node").select("node", "children", *SUMS)
