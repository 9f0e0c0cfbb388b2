"""Move generation as one broadcast join of pieces with a fixed geometry table.

The table has one row per (piece, from, to): about 4,400 rows whatever the data size. Blocked
lines, own pieces, pins and checks are filters on the position's own columns, so from position to
move there is no shuffle and no collected group.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions import bits as b
from plyframe.operators.position import POSITION_COLUMNS, with_position

MOVE_COLUMNS = ["piece", "frm", "to", "frm_bit", "to_bit", "promo", "castle", "uci"]

_ROOK = [(0, 1), (0, -1), (1, 0), (-1, 0)]
_BISHOP = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
_KNIGHT = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]
_STEPS = {  # piece -> (file, rank) steps and their reach
    "N": (_KNIGHT, 1), "B": (_BISHOP, 7), "R": (_ROOK, 7), "Q": (_ROOK + _BISHOP, 7), "K": (_ROOK + _BISHOP, 1),
}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _line(file_step: int, rank_step: int) -> str:
    if 0 in (file_step, rank_step):
        return "h" if rank_step == 0 else "v"
    if abs(file_step) != abs(rank_step):
        return ""
    return "d" if file_step == -rank_step else "a"  # squares count from the h file


@cache
def _geometry_rows() -> pa.Table:
    """Rules of movement as rows. `free` must be empty; a `take` row needs something to capture."""
    rows = []

    def add(piece, frm, to, free=0, take=False, line="", castle="", promos=("",)):
        for promo in promos:
            rows.append({
                "key": ord(piece) % 32 * 64 + frm, "to": to, "frm_bit": _signed(1 << frm), "to_bit": _signed(1 << to),
                "free": _signed(free), "take": take, "line": line, "castle": castle, "promo": promo,
                "uci_white": b.name(frm) + b.name(to) + promo, "uci_black": b.name(frm ^ 56) + b.name(to ^ 56) + promo,
            })

    for frm in range(64):
        f, r = frm % 8, frm // 8
        for piece, (steps, reach) in _STEPS.items():
            for df, dr in steps:
                free = 0
                for n in range(1, reach + 1):
                    tf, tr = f + n * df, r + n * dr
                    if not (0 <= tf < 8 and 0 <= tr < 8):
                        break
                    add(piece, frm, tr * 8 + tf, free, line=_line(df, dr))
                    free |= 1 << (tr * 8 + tf)
        if r < 7:
            promos = ("q", "r", "b", "n") if r == 6 else ("",)
            one = 1 << (frm + 8)
            add("P", frm, frm + 8, one, line="v", promos=promos)
            if r == 1:
                add("P", frm, frm + 16, one | one << 8, line="v")
            for df in (-1, 1):
                if 0 <= f + df < 8:
                    add("P", frm, frm + 8 + df, take=True, line=_line(df, 1), promos=promos)
    add("K", b.index("e1"), b.index("g1"), castle="K")
    add("K", b.index("e1"), b.index("c1"), castle="Q")
    return pa.Table.from_pylist(rows)


def geometry(spark: SparkSession) -> DataFrame:
    """The fixed table above; its size does not depend on the data."""
    return spark.createDataFrame(_geometry_rows())


def _candidate_moves(positions: DataFrame, target: str) -> DataFrame:
    """Own pieces joined with the squares they reach; `target` adds what a pawn may capture."""
    spark = positions.sparkSession
    pieces = (
        positions.select("*", F.posexplode(F.split("mover_board", "")).alias("_at", "_char"))
        # by codes: a text is put into upper case for own pieces only, not for each of the 64 squares
        .where((F.col("_char") != ".") & (F.col("white_to_move") == (F.ascii("_char") < ord("a"))))
        .withColumns({"frm": F.lit(63) - F.col("_at"), "piece": F.upper("_char")})
    )
    geo = F.broadcast(geometry(spark))
    reach = (
        (F.ascii("_char") % 32 * 64 + F.col("frm") == geo["key"])
        & F.expr("(free & occ) = 0L AND (to_bit & own) = 0L")
        & F.expr(f"(NOT take OR (to_bit & {target}) <> 0L)")
    )
    return pieces.join(geo, reach).withColumn(
        "uci", F.expr("IF(white_to_move, uci_white, uci_black)")
    )


def pseudo_legal_moves(positions: DataFrame, fen: str = "fen", pieces: str = "PNBRQK") -> DataFrame:
    """Moves by the viewer's simple rules: own king may stay in check, no castling, no en passant,
    no promotion choice. `pieces` restricts the piece types that are moved."""
    keep = positions.columns
    moves = _candidate_moves(with_position(positions, fen), "opp")
    moves = moves.where(F.col("piece").isin(*pieces) & (F.col("castle") == "") & F.col("promo").isin("", "q"))
    flip = F.when(F.col("white_to_move"), 0).otherwise(56)
    return moves.select(
        *keep, "white_to_move", "mover_board", "piece",
        F.col("frm").bitwiseXOR(flip).alias("from_sq"), F.col("to").bitwiseXOR(flip).cast("int").alias("to_sq"),
        F.expr("left(uci, 4)").alias("uci"), F.expr("(to_bit & opp) <> 0L").alias("is_capture"),
    )


def scan_order(from_sq: Column) -> Column:
    """Order in which the viewer walks the board: rank 8 first, a to h."""
    return F.lit(63) - from_sq


_LEGAL = """CASE
    WHEN castle <> '' THEN IF(castle = 'K', castle_k, castle_q)
    WHEN piece = 'K' THEN (to_bit & danger) = 0L
    WHEN take AND to_bit = ep_bit THEN (frm_bit & ep_from) <> 0L
    ELSE (to_bit & check_mask) <> 0L
        AND (line = 'v' OR (frm_bit & pin_v) = 0L) AND (line = 'h' OR (frm_bit & pin_h) = 0L)
        AND (line = 'd' OR (frm_bit & pin_d) = 0L) AND (line = 'a' OR (frm_bit & pin_a) = 0L)
    END"""


def legal_moves(positions: DataFrame, fen: str = "fen", keep_position: bool = False) -> DataFrame:
    """All legal moves, one row each, with castling, en passant and the four promotions. A FEN with a malformed field
    has none.

    `frm` and `to` are seen from the mover's side; `uci` is in board terms. With `keep_position`
    the position columns stay, as `san.with_san` needs them.
    """
    keep = positions.columns
    moves = _candidate_moves(with_position(positions, fen, strict=True), "(opp | ep_bit)").where(_LEGAL)
    return moves.select(*keep, *(POSITION_COLUMNS if keep_position else []), *MOVE_COLUMNS)


def random_baseline(positions: DataFrame, key: str, seed: str = "0", fen: str = "fen") -> DataFrame:
    """One simple-rules move per position, picked by a seeded hash; positions without moves give
    no row. A position's moves are adjacent rows, so the partial aggregate leaves one per position
    before the shuffle."""
    moves = pseudo_legal_moves(positions.select(key, fen), fen)
    pick = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("uci")))
    return moves.groupBy(key).agg(F.min(F.concat(pick, F.lit(":"), F.col("uci"))).alias("_pick")).select(
        key, F.expr("substring(_pick, 34, 2)").alias("baseline_from"), F.expr("substring(_pick, 36, 2)").alias("baseline_to")
    )
