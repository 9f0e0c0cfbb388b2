"""From evaluated positions to labelled samples.

A document is one position with its engine lines: `fen` and `evals` (array of structs with `pvs`,
an array of structs with `line`). The nested arrays are flattened in the row, the distinct first
moves of a document are checked and rendered as rows, and come back with one aggregate on the
document key. Rows of a document are adjacent, so that aggregate is done before the shuffle and
one row per document travels; over input bucketed by the key nothing travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.fen import fen_valid_strict
from plyframe.operators.position import fenced, with_position
from plyframe.operators.san import with_san, with_uci_move

EVAL_SCHEMA = (
    "fen STRING, evals ARRAY<STRUCT<knodes: BIGINT, depth: INT, "
    "pvs: ARRAY<STRUCT<cp: INT, mate: INT, line: STRING>>>>"
)


def pv_lines(evals: Column) -> Column:
    """All engine lines in document order, without null and empty ones."""
    lines = F.flatten(F.transform(
        F.coalesce(evals, F.array()),
        lambda e: F.transform(F.coalesce(e["pvs"], F.array()), lambda pv: pv["line"]),
    ))
    return F.filter(lines, lambda x: x.isNotNull() & (x != ""))


def has_blank_line(lines: Column) -> Column:
    """A line of white space only has no first word, which discards the whole document."""
    return F.exists(lines, lambda x: F.rlike(x, F.lit(r"^\s+$")))


def first_word(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*(\S+)", 1)


def flatten_pvs(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per engine line, numbered in document order; null lines are kept."""
    pvs = (
        docs.select(*keep, F.posexplode("evals").alias("eval_idx", "_eval"))
        .select(*keep, "eval_idx", F.posexplode("_eval.pvs").alias("pv_idx", "_pv"))
    )
    return pvs.select(*keep, "eval_idx", "pv_idx", F.col("_pv.cp").alias("cp"), F.col("_pv.mate").alias("mate"),
                      F.col("_pv.line").alias("line"))


def legal_candidates(docs: DataFrame, key: str) -> DataFrame:
    """The legal first moves of each document: key, fen, position in document order, uci, san.

    Documents with a malformed FEN or a blank engine line are rejected whole. The tests on lines and heads are fenced: pushed
    down, each would make the lines from `evals` once more.
    """
    lines = pv_lines(F.col("evals"))
    heads = (
        docs.where(fen_valid_strict(F.col("fen")))
        .select(key, "fen", lines.alias("_lines"))
        .withColumn("_blank", has_blank_line(F.col("_lines")))
        .withColumn("_fit", F.expr(fenced("NOT _blank")))
        .where("_fit")
        .select(key, "fen", F.array_distinct(F.transform("_lines", first_word)).alias("_heads"))
        .withColumn("_some", F.expr(fenced("size(_heads) > 0")))
        .where("_some")
        .select(key, "fen", "_heads")
    )
    moves = with_position(heads).withColumn("_h", F.expr("explode(arrays_zip(_heads, sequence(0, size(_heads) - 1)))"))
    moves = moves.withColumns({"head": F.col("_h._heads"), "ord": F.col("_h").getField("1")})
    moves = with_san(with_uci_move(moves.drop("_h", "_heads"), "head"))
    return moves.where("ok").select(key, "fen", "ord", "head", "uci", "san")


def top_moves(candidates: DataFrame, key: str, max_moves: int = 5) -> DataFrame:
    """Distinct legal moves per document in first-seen order, at most `max_moves`; the first one is
    the best move. A document's candidates are bounded by the legal moves of one position."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "san"))), lambda x: x["san"]
    )
    return (
        candidates.groupBy(key, "fen").agg(ordered.alias("_sans"))
        .select(key, "fen", F.slice(F.array_distinct("_sans"), 1, max_moves).alias("top_moves"))
        .select(key, "fen", F.col("top_moves")[0].alias("best_move"), "top_moves")
    )


def valid_samples(docs: DataFrame, key: str, max_moves: int = 5) -> DataFrame:
    """Documents that give a sample: key, fen, best_move, top_moves."""
    return top_moves(legal_candidates(docs, key), key, max_moves)
