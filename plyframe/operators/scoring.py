"""Scoring of moves and the rates computed from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.fen import fen_valid_strict, side_to_move
from plyframe.functions.text import eval_bucket
from plyframe.operators.position import never_null, with_position
from plyframe.operators.replies import reply_to_san
from plyframe.operators.san import with_san_move

RESULT_COLUMNS = ["id", "fen", "model_move", "full_reply", "legal", "good", "top_moves"]


def score_moves(rows: DataFrame, san: str = "model_move", top: str = "top_moves", fen: str = "fen") -> DataFrame:
    """Add `legal` (the text resolves to a legal move) and `good` (exact text among the top moves)."""
    keep = rows.columns
    moves = with_san_move(with_position(rows, fen, strict=True), san)
    good = F.coalesce(F.array_contains(top, F.col(san)), F.lit(False))
    return moves.select(*keep, F.col("ok").alias("legal"), good.alias("good"))


def positioned_samples(samples: DataFrame) -> DataFrame:
    """id, fen, top_moves of the samples with a well-formed FEN, and the columns of its position."""
    return with_position(samples.where(fen_valid_strict(F.col("fen"))).select("id", "fen", "top_moves"), strict=True)


def evaluate_replies(samples: DataFrame, replies: DataFrame, use_marker: bool = True, positioned: bool = False) -> DataFrame:
    """Pair samples with replies by `id`, parse, score: model and RESULT_COLUMNS.

    `samples` has id (unique), fen, top_moves; `replies` has model, id, full_reply. A parsed move is
    canonical and legal by construction, so legality needs no second look. Replies to a sample with a malformed FEN give no
    row and count in no rate; ids keep their gaps. The position is read once
    for each sample, before the join with its replies; the side with many replies to one sample is
    split at run time by the adaptive join. With `positioned` the samples are those of `positioned_samples`.
    """
    positions = never_null(samples) if positioned else positioned_samples(samples)
    pairs = replies.select("model", "id", "full_reply").join(positions, "id")
    parsed = reply_to_san(pairs, use_marker, positioned=True)
    return parsed.select(
        "model", "id", "fen", "model_move", "full_reply",
        (F.col("model_move") != "").alias("legal"),
        F.array_contains("top_moves", F.col("model_move")).alias("good"), "top_moves",
    )


def rate(flag: Column) -> Column:
    """Percent of rows where `flag` holds; null without rows."""
    return F.avg(flag.cast("int")) * 100


def move_rates(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("test_samples"), rate(F.col("legal")).alias("legal_move_rate"),
        rate(F.col("good")).alias("top_move_rate"),
    )


def model_summary(scored: DataFrame, with_time: bool = True) -> DataFrame:
    """One summary record per model; a model without rows has no record."""
    out = move_rates(scored, "model")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return out.withColumn("timestamp", stamp) if with_time else out


def guarded_rates(scored: DataFrame) -> DataFrame:
    """Overall rates; on an empty frame one row with zero samples and null rates."""
    return move_rates(scored).withColumn("has_results", F.col("test_samples") > 0)


def topn_rates(scored: DataFrame, n: int = 5) -> DataFrame:
    """Rate of the best move (rank 1) and of the first `n`, per model."""
    rank = F.array_position("top_moves", F.col("model_move"))
    return scored.groupBy("model").agg(
        rate(rank == 1).alias("best_move_rate"), rate(rank.between(1, n)).alias("top_n_rate")
    )


def cp_correlation(rows: DataFrame, x: str, cp: str = "cp", *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.corr(x, cp).alias("correlation"), F.count("*").alias("n"))


def rate_by_position_type(scored: DataFrame) -> DataFrame:
    """Rates by model, evaluation bucket and side, with totals. `scored` carries `cp` and `mate`."""
    side = side_to_move(F.col("fen"))
    rows = scored.withColumns({"side": side}).withColumn(
        "bucket", eval_bucket(F.col("cp"), F.col("mate"), F.col("side") == "White")
    )
    return rows.rollup("model", "bucket", "side").agg(
        F.count("*").alias("n"), rate(F.col("legal")).alias("legal_rate"), rate(F.col("good")).alias("good_rate"),
        F.stddev_pop(F.col("legal").cast("int")).alias("legal_stddev"),
    )
