"""From a model's reply to one canonical move. Row-local, so it runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions import text as t
from plyframe.operators.position import POSITION_COLUMNS, with_position
from plyframe.operators.san import with_san, with_san_move


def reply_to_san(replies: DataFrame, use_marker: bool = True, fen: str = "fen", reply: str = "full_reply",
                 out: str = "model_move", positioned: bool = False) -> DataFrame:
    """Add `out`: the SAN the reply stands for, '' if it names no legal move.

    `use_marker` looks behind the last marker only; otherwise the whole reply is searched. With `positioned` the rows
    bring the columns of a strict `with_position`, which are dropped here.
    """
    keep = [c for c in replies.columns if not (positioned and c in POSITION_COLUMNS)]
    rows = replies.withColumn("_candidate", t.candidate(F.col(reply), use_marker))
    if not positioned:
        # A reply that names no move needs no board: its FEN is not read.
        rows = with_position(rows.withColumn("_asked", F.when(F.col("_candidate") != "", F.col(fen))), "_asked", strict=True)
    rows = with_san(with_san_move(rows, "_candidate", lenient=True), "_san_out")
    return rows.select(*keep, F.coalesce("_san_out", F.lit("")).alias(out))


def resolve_san(rows: DataFrame, san: str, fen: str = "fen", lenient: bool = False, out: str = "resolved") -> DataFrame:
    """Add `out`: canonical SAN of the one legal move that `san` can mean, null if none."""
    keep = rows.columns
    return with_san(with_san_move(with_position(rows, fen, strict=True), san, lenient), out).select(*keep, out)


def unparsed_replies(scored: DataFrame) -> DataFrame:
    """Replies without a usable move, per model."""
    return scored.groupBy("model").agg(
        F.count("*").alias("replies"), F.count_if(F.col("model_move") == "").alias("unparsed")
    )


def parse_tags(replies: DataFrame, reply: str = "full_reply") -> DataFrame:
    """Tags of a structured reply, with the number of moves named in `choose`."""
    tags = {name: t.tag_text(F.col(reply), name)
            for name in ("board_position", "evaluate", "perceive", "predict", "choose")}
    out = replies.withColumns(tags).withColumn("_moves", t.moves_in(F.col("choose")))
    return out.withColumns({
        "chosen": F.coalesce(F.get("_moves", F.lit(0)), F.lit("")), "n_moves": F.size("_moves"),
        "several_moves": F.size("_moves") > 1,
    }).drop("_moves")
