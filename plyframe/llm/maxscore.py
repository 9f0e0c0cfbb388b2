"""Exact top-k search by inner product with MaxScore.

A term is a dimension with a sign; its postings in a shard are the vectors whose value there has that sign. For a query
the terms of its own signs can only raise a score, each by at most |query value| x the largest value in the postings;
terms of the opposite sign only lower it. Terms are sorted by that bound. Those whose bounds together stay under the
score of the k-th best vector so far are non-essential: a vector found in none of the other, essential postings cannot
compete. Essential postings are traversed, the rest is probed term by term while a vector can still reach the k-th
score. Shards are searched on their own and their best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyframe.plans.scratch import written

SHARD = 4096
QUERIES = 512
PROBE = 8
SALTS = 16
EXACT = 2.0**53
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
BEYOND = 2400  # bits of the largest products of doubles and their sums


class Shard:
    """Postings of one shard: values by dimension, and for each (dimension, sign) the rows and the largest size. Values
    are doubles, or Python's whole numbers where sums of doubles would not be exact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order].T)
        self.up = [np.flatnonzero(v > 0) for v in self.values]
        self.down = [np.flatnonzero(v < 0) for v in self.values]
        self.most = np.maximum(self.values.max(axis=1), 0), np.maximum((-self.values).max(axis=1), 0)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the shard but the query's own, ties to the smaller id."""
        bounds = np.where(query > 0, query * self.most[0], -query * self.most[1])
        terms = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])  # bound of the terms from here on
        first = np.flatnonzero(self.ids != query_id)[: 4 * k]
        start = query @ self.values[:, first]
        floor = np.partition(start, len(start) - k)[-k] if len(start) >= k else -np.inf
        essential = int(np.searchsorted(-rest, -floor, side="right")) if floor > -np.inf else len(terms)
        essential = min(len(terms), max(essential, 0))
        found = np.zeros(len(self.ids), bool)
        if floor <= 0:  # a row without any raising term scores 0 at most and may compete
            found[:] = True
        else:
            for d in terms[:essential]:
                found[(self.up if query[d] > 0 else self.down)[d]] = True
                if found.all():
                    break
        rows = np.flatnonzero(found & (self.ids != query_id))
        score = np.zeros(len(rows), self.values.dtype)
        for at in range(0, len(terms), PROBE):  # the essential terms in full, then the others while rows compete
            step = terms[at : at + PROBE]
            score += query[step] @ self.values[np.ix_(step, rows)]
            if at + PROBE >= essential:
                alive = score + rest[min(at + PROBE, len(terms))] >= floor
                if not alive.all():
                    rows, score = rows[alive], score[alive]
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[-k]
            rows, score = rows[keep], score[keep]
        order = np.argsort(self.ids[rows], kind="stable")
        order = order[np.argsort(-score[order], kind="stable")][:k]
        return self.ids[rows[order]], score[order]


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, x) as blocks: ids and matrix as bytes. Large rows are blocks of their own."""
    held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    for batch in batches:
        for i, x in zip(batch["id"].to_pylist(), batch["x"].to_pylist(), strict=True):
            ids, rows = held[_large(x)]
            ids.append(i)
            rows.append(x)
            if len(rows) == size:
                yield _block(ids, rows)
                ids.clear(), rows.clear()
    for ids, rows in held.values():
        if rows:
            yield _block(ids, rows)


def _large(x: list[float]) -> bool:
    """Whether products of this vector with one like it may have sums that doubles do not hold exactly. The product of
    two vectors of which neither is large is exact."""
    most = max(map(abs, x), default=0.0)
    return most * most * len(x) > EXACT


def _whole(values: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(values).astype(object)


def _block(ids: list[int], rows: list[list[float]]) -> pa.RecordBatch:
    matrix = np.zeros((len(rows), max(map(len, rows))))
    for i, x in enumerate(rows):
        matrix[i, : len(x)] = x
    return pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "matrix": [matrix.tobytes()]},
                                      pa.schema([("ids", pa.binary()), ("matrix", pa.binary())]))


def _query_block(rows: pa.Table) -> pa.Table:
    packed = _block(rows["id"].to_pylist(), rows["x"].to_pylist())
    return pa.table({"block": rows["block"].slice(0, 1), "q_ids": packed["ids"], "q_matrix": packed["matrix"]})


def _unpacked(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    number = np.frombuffer(ids, np.int64)
    return number, np.frombuffer(matrix).reshape(len(number), -1)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, matrix, q_ids, q_matrix in zip(*(batch[c].to_pylist() for c in ("ids", "matrix", "q_ids", "q_matrix")), strict=True):
            rows, (numbers, queries) = _unpacked(ids, matrix), _unpacked(q_ids, q_matrix)
            width = max(rows[1].shape[1], queries.shape[1])
            values = np.pad(rows[1], ((0, 0), (0, width - rows[1].shape[1])))
            shard, exact = Shard(rows[0], values), None
            large = any(map(_large, values.tolist()))
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            out: list[tuple[int, int, int, str | None]] = []
            for number, query in zip(numbers.tolist(), queries, strict=True):
                if large or _large(query.tolist()):
                    exact = exact or Shard(rows[0], _whole(values))
                    found, scores = exact.best(number, _whole(query), k)
                else:
                    found, scores = shard.best(number, query, k)
                out += [(number, i, *_bounded(int(s))) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["query_id", "vec_id", "score", "beyond"])


def _bounded(score: int) -> tuple[int, str | None]:
    """A score as a 64-bit number; one beyond is given at the limit, with a text of fixed length that sorts as it does."""
    if LOWEST < score <= HIGHEST:
        return score, None
    return max(LOWEST, min(HIGHEST, score)), f"{score + (1 << BEYOND):0{BEYOND // 4 + 1}x}"


def top_k(vectors: DataFrame, id: str, vector: str, query: str, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row that satisfies `query` (SQL over the id).

    `vector` holds whole numbers as doubles. Scores are exact: vectors too large for sums of doubles are multiplied as
    whole numbers of any size, and a score beyond 64 bits is ranked by its value and given as the nearest 64-bit number. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id; a missing trailing component counts as 0. Ties go to
    the smaller id; a row never meets rows of its own id. Rows that repeat an id count once per row as candidates and
    once in all as a query, by the smallest vector. Fewer candidates than k give fewer rows, an empty table gives none.

    Blocks of queries meet shards of rows by an equality join on the block's number and a salt of the shard, a stated
    query set against all rows.
    """
    x = F.col("x")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(
        F.col("id").isNotNull() & x.isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    asked = written(rows.where(query).groupBy("id").agg(F.min("x").alias("x")))
    n = max(1, -(-asked.count() // QUERIES))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(
        _query_block, "block int, q_ids binary, q_matrix binary").select("*", salts)
    shards = rows.mapInArrow(lambda b: _packed(b, SHARD), "ids binary, matrix binary").withColumn(
        "salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
    pairs = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(blocks, ["block", "salt"])
    found = pairs.select("ids", "matrix", "q_ids", "q_matrix").mapInArrow(
        lambda b: _searched(b, k), "query_id long, vec_id long, score long, beyond string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
