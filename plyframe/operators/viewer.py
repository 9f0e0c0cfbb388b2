"""The board viewer's data steps: its simplified move reading, baseline, comparison and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions import bits as b
from plyframe.functions.fen import board_string, fen_valid_viewer, side_to_move
from plyframe.operators.moves import pseudo_legal_moves, random_baseline
from plyframe.operators.position import fenced, pseudo_origins, select_sql, with_position, with_reach
from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written

# --- fixed values -------------------------------------------------------------------------
MATCH = "Great! Your move matches the LLM suggestion."
NO_MATCH = "Your move differs from the LLM suggestion."
NO_SUGGESTION = "LLM had no suggestion for this position."
BEST = "✅ LLM predicted move was the best move."
NOT_BEST = "❌ LLM predicted move was NOT the best move."
SUGGESTED = "LLM suggested move: "
SIDE_MOVES = "It is ", "'s move. Select a piece to play your move."
INVALID = "Invalid FEN in dataset entry."
# ------------------------------------------------------------------------------------------


def board_squares(boards: DataFrame, key: str, board: str = "board") -> DataFrame:
    """One row per occupied square of a 64-character board (a1 .. h8)."""
    rows = boards.select(key, F.posexplode(F.split(board, "")).alias("sq", "piece")).where(F.col("piece") != ".")
    return rows.select(
        key, "sq", "piece", F.lower("piece").alias("type"),
        F.when(F.upper("piece") == F.col("piece"), "w").otherwise("b").alias("color"),
    )


def san_to_squares(rows: DataFrame, san: str, fen: str = "fen") -> DataFrame:
    """Add `from_name` and `to_name`, null where the text is not read.

    Simplified reading: no castling, promotion or en passant; the capture sign must agree with the
    target; of several pieces the first in board order (rank 8 first, a to h) is taken.
    """
    keep = rows.columns
    text = F.regexp_replace(F.btrim(F.coalesce(F.col(san), F.lit("")), F.lit(" \t\n\r\x0b\x0c")), r"[+#]+$", "")
    rows = with_position(rows.withColumn("_text", text), fen).withColumn(
        "_target", F.when(F.rlike("_text", F.lit("^(O-O(-O)?|0-0(-0)?)$")), "").otherwise(
            F.regexp_extract("_text", "([a-h][1-8])$", 1))
    )
    rows = select_sql(rows, {
        "_to_bit": f"IF(_target = '', 0L, shiftleft(1L, CASE WHEN _target = '' THEN 0 ELSE {b.index_sql('_target')}"
                   " ^ IF(white_to_move, 0, 56) END))",
        "_piece": "IF(_text rlike '^[KQRBN]', left(_text, 1), 'P')",
    })
    rows = with_reach(rows, "_to_bit")
    fits = "IF(contains(_text, 'x'), (_to_bit & opp) <> 0L, (_to_bit & occ) = 0L)"
    rows = select_sql(rows, {"_set": f"IF(_to_bit <> 0L AND {fits}, {pseudo_origins('_piece', '_to_bit')}, 0L)"})
    # Board order starts at the highest bit for White; for Black the mover's view is upside down.
    ranks = range(8, 0, -1)
    white = "CASE " + " ".join(
        f"WHEN (_set & {b.const(b.rank(r))}) <> 0L THEN _set & {b.const(b.rank(r))}" for r in ranks) + " ELSE 0L END"
    black = "CASE " + " ".join(
        f"WHEN (_set & {b.const(b.rank(r))}) <> 0L THEN _set & {b.const(b.rank(r))}" for r in reversed(ranks)) + " ELSE 0L END"
    rows = select_sql(rows, {"_row": f"IF(white_to_move, {white}, {black})"})
    files = "CASE " + " ".join(
        f"WHEN (_row & {b.const(b.FILE_H << n)}) <> 0L THEN _row & {b.const(b.FILE_H << n)}" for n in range(7, -1, -1)
    ) + " ELSE 0L END"
    rows = select_sql(rows, {"_one": files})
    rows = select_sql(rows, {"_found": fenced("_one <> 0L"), "_sq": f"IF(_one = 0L, 0, {b.index_of('_one')}) ^ IF(white_to_move, 0, 56)"})
    return rows.select(
        *keep, F.expr(f"IF(_found, {b.name_sql('_sq')}, NULL)").alias("from_name"),
        F.expr("IF(_found, _target, NULL)").alias("to_name"),
    )


def model_move_or_baseline(entries: DataFrame, key: str, san: str = "model_move", seed: str = "0") -> DataFrame:
    """The model's move as squares, else the seeded baseline; both null if there is no move.

    The texts are read once and written; moves are generated only for the rows that need them. The hash depends on the key, so
    the choice is the same on every run.
    """
    read = written(san_to_squares(entries, san))
    need = read.where(F.col("from_name").isNull()).select(key, "fen")
    base = random_baseline(need, key, seed)
    return read.join(base, key, "left").select(
        *entries.columns,
        F.coalesce("from_name", "baseline_from").alias("llm_from"),
        F.coalesce("to_name", "baseline_to").alias("llm_to"),
        F.col("from_name").isNull().alias("is_baseline"),
    )


def piece_destinations(positions: DataFrame, key: str, from_name: Column, fen: str = "fen") -> DataFrame:
    """Simple-rules destinations of the piece on a chosen square of each position; the square is worked out once a position."""
    moves = pseudo_legal_moves(positions.withColumn("_from", from_name), fen)
    return moves.where(F.left("uci", F.lit(2)) == F.col("_from")).select(
        key, F.left("uci", F.lit(2)).alias("from_name"), F.expr("right(uci, 2)").alias("to_name")
    )


def compare_moves(user_moves: DataFrame, entries: DataFrame, reply_model: str = "gpt20b") -> DataFrame:
    """User's move against the suggestion, with the texts shown.

    `user_moves`: model, id, user_from, user_to. `entries`: model, id, llm_from, llm_to, full_reply,
    good. The reply is shown for one model only.
    """
    rows = user_moves.join(entries, ["model", "id"])
    match = F.coalesce((F.col("user_from") == F.col("llm_from")) & (F.col("user_to") == F.col("llm_to")), F.lit(False))
    arrow = F.lit(" → ")
    return rows.select(
        "model", "id", match.alias("is_match"), F.when(match, MATCH).otherwise(NO_MATCH).alias("status"),
        F.concat("user_from", arrow, "user_to").alias("user_text"),
        F.when(F.col("llm_from").isNull(), NO_SUGGESTION)
        .otherwise(F.concat(F.lit(SUGGESTED), "llm_from", arrow, "llm_to")).alias("llm_text"),
        F.when(F.col("model") == reply_model, F.coalesce("full_reply", F.lit(""))).otherwise("").alias("reply_text"),
        F.when(F.col("good"), BEST).when(~F.col("good"), NOT_BEST).otherwise("").alias("verdict"),
    )


def entry_by_index(entries: DataFrame, index: int, key: str, group: list[str]) -> DataFrame:
    """Entry number `index` of each group with its board; a bad FEN gives a message and no board."""
    rows = dense_ordinal(entries, key, group, below=index + 1).where(F.col("ord") == index)
    valid = fen_valid_viewer(F.col("fen"))
    side = side_to_move(F.col("fen"))
    return rows.select(
        *group, key, "fen", valid.alias("valid"),
        F.when(valid, F.concat(F.lit(SIDE_MOVES[0]), side, F.lit(SIDE_MOVES[1]))).otherwise(INVALID).alias("message"),
    )


def entry_view(entries: DataFrame, index: int, key: str, group: list[str], san: str = "model_move", seed: str = "0") -> DataFrame:
    """Entry number `index` of each group as it is shown: `entry_by_index`, its board, and the model's move or the
    baseline. An entry with a bad FEN has neither board nor move. `key` is unique over all groups."""
    shown = written(dense_ordinal(entries, key, group, below=index + 1).where(F.col("ord") == index).drop("ord"))
    moves = model_move_or_baseline(shown.where(fen_valid_viewer(F.col("fen"))), key, san, seed)
    told = entry_by_index(shown, 0, key, group)
    return told.join(moves.select(key, "llm_from", "llm_to", "is_baseline"), key, "left").select(
        *told.columns, F.when(F.col("valid"), board_string(F.col("fen"))).alias("board"), "llm_from", "llm_to", "is_baseline")
