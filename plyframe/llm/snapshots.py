"""Chat formatting after collapsing cumulative snapshots.

A conversation that is logged after every turn appears once in full and many times as a prefix of itself. Every turn
gets a rolling hash of the turns up to it; a conversation whose last hash is the inner hash of another one is a
snapshot of it. An anti-join keeps the maximal conversations, which are then rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.plans.scratch import written

BLOCK_BITS = 12


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, h1, h2: the two rolling hashes of the turns up to this one.

    Turns are ordered by turn (null first), then role, then text; rows equal in all of them count once. Running counts
    and hashes are taken inside blocks of 4,096 turn numbers and carried over by block totals, so that a long
    conversation is spread over tasks.
    """
    block = [F.col("conv_id"), F.col("_block")]
    order = Window.partitionBy(*block).orderBy("turn", "role", "text")
    carried = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    logged = F.struct("turn", "role", "text")
    t = turns.withColumn("_block", F.shiftright(F.coalesce("turn", F.lit(0)), BLOCK_BITS) - F.col("turn").isNull().cast("int"))
    t = t.withColumn("_again", logged.eqNullSafe(F.lag(logged).over(order))).where(~F.col("_again")).drop("_again")
    t = t.withColumn("_local", F.row_number().over(order))
    starts = t.groupBy("conv_id", "_block").agg(F.count("*").alias("_rows")).select(
        "conv_id", "_block", F.coalesce(F.sum("_rows").over(carried), F.lit(0)).alias("_start"))
    t = t.join(starts, ["conv_id", "_block"]).withColumn("pos", F.col("_start") + F.col("_local"))
    t = written(t.select("conv_id", "_block", "pos", "role", "text", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2")))
    upto = Window.partitionBy(*block).orderBy("pos")
    before = t.groupBy("conv_id", "_block").agg(F.expr("bit_xor(t1)").alias("b1"), F.expr("bit_xor(t2)").alias("b2"))
    before = before.select("conv_id", "_block", *(
        F.coalesce(F.expr(f"bit_xor({b})").over(carried), F.lit(0)).alias(b) for b in ("b1", "b2")))
    t = t.withColumn("t1", F.expr("bit_xor(t1)").over(upto)).withColumn("t2", F.expr("bit_xor(t2)").over(upto))
    return t.join(before, ["conv_id", "_block"]).select(
        "conv_id", "pos", "role", "text", F.col("t1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("t2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: one conversation (the smallest id) of each text that no longer one begins with."""
    key = ["pos", "h1", "h2"]
    lengths = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = prefixes.select("conv_id", *key).join(lengths, "conv_id")
    inner = marked.where(F.col("pos") < F.col("n_turns")).select(*key).distinct()
    whole = marked.where(F.col("pos") == F.col("n_turns")).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between the usual chat markers; a null role is a user's, a null text is empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")),
                    F.lit("<|im_end|>\n"))


def chat_records(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, n_turns, copies (conversations with exactly these turns), rendered: the maximal conversations.

    Rows without a conversation id belong to none and give nothing. A null role or text differs from an empty one when
    conversations are compared. An empty table gives no rows; other columns are not read. A rendered conversation is
    one value, so a conversation must fit a row; everything before rendering works turn by turn.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    prefixes = written(prefix_hashes(t.where(F.col("conv_id").isNotNull())))
    kept = maximal(prefixes)
    said = prefixes.select("conv_id", F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("said")).alias("turn"))
    bodies = said.join(kept.select("conv_id"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return kept.join(bodies, "conv_id").select(
        "conv_id", "n_turns", "copies", F.array_join(F.col("turns.said"), "").alias("rendered"))
