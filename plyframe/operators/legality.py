"""Legal moves of distinct positions as sets of from-to pairs, looked up by many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.fen import fen_valid_strict
from plyframe.operators.moves import legal_moves
from plyframe.plans.scratch import written


def position_key(fen: Column) -> Column:
    """The fields that decide which moves are legal: placement, side, castling rights, en passant square. Null for a FEN
    with a malformed field."""
    return F.when(fen_valid_strict(fen), F.concat_ws(" ", F.slice(F.split(F.trim(fen), r"\s+"), 1, 4)))


def _square(uci: Column, at: int) -> Column:
    return (F.ascii(F.substring(uci, at, 1)) - 97 + 8 * (F.ascii(F.substring(uci, at + 1, 1)) - 49)).cast("int")


def _bit(square: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), square)


def legality_bitmap(positions: DataFrame, fen: str = "fen") -> DataFrame:
    """position, bits: a row for each distinct position, however many rows have it; bits[from] has bit `to` set if a legal move
    goes from one square to the other (a1 is 0, h8 is 63). Promotions to several pieces are one pair."""
    keys = written(positions.select(position_key(F.col(fen)).alias("position")).where("position IS NOT NULL").distinct())
    moves = legal_moves(keys, "position").select("position", _square(F.col("uci"), 1).alias("frm"), _square(F.col("uci"), 3).alias("to"))
    sets = moves.groupBy("position", "frm").agg(F.bit_or(_bit(F.col("to"))).alias("bits"))
    sets = sets.groupBy("position").agg(F.map_from_entries(F.collect_list(F.struct("frm", "bits"))).alias("at"))  # 64 entries at most
    squares = F.sequence(F.lit(0), F.lit(63))
    return keys.join(sets, "position", "left").select(
        "position", F.transform(squares, lambda s: F.coalesce(F.element_at("at", s), F.lit(0).cast("long"))).alias("bits"))


def with_legality(rows: DataFrame, fen: str = "fen", bitmap: DataFrame | None = None, out: str = "bits") -> DataFrame:
    """Add the legal from-to pairs of each row's position, null for a malformed FEN; `bitmap` may be kept from an earlier
    call. The join shuffles both sides, so that the adaptive join splits a position that many rows have."""
    bitmap = legality_bitmap(rows, fen) if bitmap is None else bitmap
    found = bitmap.select(F.concat("position", F.lit("")).alias("_key"), F.col("bits").alias(out))
    return rows.withColumn("_key", position_key(F.col(fen))).join(found, "_key", "left").select(*rows.columns, out)


def allows(bits: Column, uci: Column) -> Column:
    """Whether a legal move goes between the two squares a move in UCI names; false for what names none."""
    named = uci.rlike("^[a-h][1-8][a-h][1-8][qrbn]?$")
    hit = F.get(bits, _square(uci, 1)).bitwiseAND(_bit(_square(uci, 3))) != 0
    return F.coalesce(F.when(named, hit), F.lit(False))
