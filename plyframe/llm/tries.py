"""The trie of conversation prefixes, with totals of every subtree.

Each turn is reduced to hashes and a length in the scan, so no text is shuffled. Running hashes of a conversation's turns
name its prefixes; equal prefixes are one node, and a node's parent is the prefix without the last turn. Totals of
subtrees come from `contraction`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.llm.contraction import subtree_totals
from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written

BLOCK_BITS = 16
CHUNK = 1 << 16
PREFIX = ["depth", "p1", "p2"]
ENDS = "depth long, p1 long, p2 long, first long, ids binary"
DIGESTS = "depth long, p1 long, p2 long, ends_sha256 string"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), c1, c2 (hashes of role and text), chars (code points of the text) for every row.

    Turns are ordered by turn, null first, then by role and by hash; equal rows are turns of their own. A null role or
    text is an empty one. Rows without a conversation id belong to none and are left out.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), by.alias("role"),
        F.xxhash64(F.lit(1), by, said).alias("c1"), F.xxhash64(F.lit(2), by, said).alias("c2"),
        F.length(said).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    ordered = dense_ordinal(rows, ["turn", "role", "c1", "c2", "row"], ["conv_id"], out="pos")
    return ordered.select("conv_id", (F.col("pos") + 1).alias("pos"), "c1", "c2", "chars")


def reopened(turns: DataFrame, anchor: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one: (conversations with their number of turns, turns).

    `turns` is as `numbered` gives it. A conversation takes the first `heads` (at most `most`) turns of the conversation `anchor`, all if
    that has fewer and none if it is absent, and then its own turns after its first `heads`. Both are expressions of conv_id.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"anchor": anchor, "heads": heads.cast("long")})
    own = written(own)
    others = own.select(F.col("conv_id").alias("anchor"), F.col("n").alias("held"))
    convs = own.join(others, "anchor", "left").withColumn("taken", F.least("heads", F.coalesce("held", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    convs = written(convs.select("conv_id", "anchor", "heads", "taken", length.alias("length")))
    body = ["c1", "c2", "chars", "length"]
    rest = turns.join(convs, "conv_id").where("pos > heads").select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken")).alias("pos"), *body)
    first = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("anchor"), "pos", "c1", "c2", "chars")
    shared = convs.where("taken > 0").join(first, "anchor").where("pos <= taken").select("conv_id", "pos", *body)
    return convs.select("conv_id", "length"), rest.union(shared)


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` with p1, p2: running hashes of the turns up to this one, and q1, q2: of those before it.

    Running hashes are taken inside blocks of 65,536 turns and carried over by block totals, so that a long conversation
    is spread over tasks.
    """
    t = turns.withColumns({"block": F.shiftright("pos", BLOCK_BITS), "t1": F.xxhash64(F.lit(3), "pos", "c1", "c2"),
                           "t2": F.xxhash64(F.lit(4), "pos", "c1", "c2")})
    t = written(t)
    upto = Window.partitionBy("conv_id", "block").orderBy("pos")
    carried = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = t.where("length >= " + str(1 << BLOCK_BITS)).groupBy("conv_id", "block").agg(
        F.expr("bit_xor(t1)").alias("b1"), F.expr("bit_xor(t2)").alias("b2"))
    long = long.select("conv_id", "block", F.expr("bit_xor(b1)").over(carried).alias("b1"), F.expr("bit_xor(b2)").over(carried).alias("b2"))
    t = t.withColumns({"x1": F.expr("bit_xor(t1)").over(upto), "x2": F.expr("bit_xor(t2)").over(upto)})
    t = t.join(long, ["conv_id", "block"], "left")
    t = t.withColumns({p: F.col(x).bitwiseXOR(F.coalesce(b, F.lit(0))) for p, x, b in (("p1", "x1", "b1"), ("p2", "x2", "b2"))})
    return t.select("conv_id", F.col("pos").alias("depth"), "chars", "length", "p1", "p2",
                    F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix and conversation: their ids, comma-joined in rows of up to CHUNK bytes."""
    out: list[tuple] = []
    key, first, held, size = None, None, [], 0
    for batch in batches:
        for *now, conv in zip(*(batch[c].to_pylist() for c in (*PREFIX, "conv_id")), strict=True):
            if now != key or size > CHUNK:
                if held:
                    out.append((*key, first, b",".join(held)))
                key, first, held, size = now, conv, [], 0
            held.append(b"%d" % conv)
            size += len(held[-1]) + 1
        if len(out) > 1000 or sum(len(o[-1]) for o in out) > 1 << 23:
            yield _rows(out, (pa.int64(),) * 4 + (pa.binary(),), (*PREFIX, "first", "ids"))
            out = []
    if held:
        out.append((*key, first, b",".join(held)))
    yield _rows(out, (pa.int64(),) * 4 + (pa.binary(),), (*PREFIX, "first", "ids"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix and first id: the digest of all ids of a prefix, read as a stream."""
    key, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for *now, ids in zip(*(batch[c].to_pylist() for c in (*PREFIX, "ids")), strict=True):
            if now != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield _rows(out, (pa.int64(),) * 3 + (pa.string(),), (*PREFIX, "ends_sha256"))
    yield _rows([(*key, state.hexdigest())] if key else [], (pa.int64(),) * 3 + (pa.string(),), (*PREFIX, "ends_sha256"))


def _rows(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def ends(rows: DataFrame) -> DataFrame:
    """Prefix and ends_sha256, the digest of the comma-joined ids, ascending, of the conversations (conv_id) that end there.

    Ids are joined to chunks in ranges, so that a prefix with most conversations is spread over tasks, and the task that
    digests a prefix reads chunks.
    """
    ordered = rows.select(*PREFIX, "conv_id").repartitionByRange(*PREFIX, "conv_id").sortWithinPartitions(*PREFIX, "conv_id")
    chunks = written(ordered.mapInArrow(_chunked, ENDS))
    return chunks.repartition(*PREFIX).sortWithinPartitions(*PREFIX, "first").mapInArrow(_digested, DIGESTS)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one included: conv_id (the smallest of those that begin with
    it), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points of the last turn's text times
    n_convs - 1, summed over the subtree), ends_sha256 (of the conversations that are this prefix).

    `convs` has conv_id and length, one row for each conversation, also those without turns; `turns` has conv_id, pos, c1, c2,
    chars, length. No conversations give no rows. Prefixes are told apart by 128 bits of hash.
    """
    said = written(prefixes(turns))
    inner = said.groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                      F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(c) for c in PREFIX), "conv_id", "n_convs", zero.alias("chars"), zero.alias("q1"), zero.alias("q2"))
    nodes = written(inner.unionByName(top).withColumn("node", F.monotonically_increasing_id()))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                      F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("value")
    tree = written(nodes.join(up, ["depth", "q1", "q2"], "left").select(
        "node", "parent", saved, "conv_id", *PREFIX, "parent_conv_id", "n_convs"))
    last = said.where("depth = length").select(*PREFIX, "conv_id").union(
        convs.where("length = 0").select(*(zero.alias(c) for c in PREFIX), "conv_id"))
    digests = ends(last)
    return tree.join(subtree_totals(tree), "node").join(digests, PREFIX, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("total").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
