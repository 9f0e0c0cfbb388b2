"""Column expressions over FEN text.

Two notions of "valid" exist side by side: the viewer's parser (placement and side only) and
the strict parser used when samples are built (all fields, no two digits in a row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
PIECES = "PNBRQKpnbrqk"
PIECE_SYMBOLS = "♙♘♗♖♕♔♟♞♝♜♛♚"
EMPTY_SYMBOL = "·"
SPACE = " \t\n\r\x0b\x0c"
# ----------------------------------------------------------------------------------------

_RANK = "[.PNBRQKpnbrqk]{8}"
_EIGHT_RANKS = f"^{_RANK}(/{_RANK}){{7}}$"
_STRICT_FIELDS = (
    r"^\S+(\s+[wb](\s+(-|(?=\S)[KQABCDEFGH]{0,2}[kqabcdefgh]{0,2})"
    r"(\s+(-|[a-h][1-8])(\s+\d+(\s+\d+)?)?)?)?)?$"
)
_DASHES = "  " + "-" * 17 + "\n"


def fen_fields(fen: Column) -> Column:
    """Whitespace-separated fields."""
    return F.split(F.btrim(fen, F.lit(SPACE)), r"\s+")


def fen_field(fen: Column, i: int) -> Column:
    """Field `i` of a FEN, null where it is absent."""
    return F.get(fen_fields(fen), F.lit(i))


def expand_ranks(placement: Column) -> Column:
    """Placement with every digit written out as dots; the slashes stay.

    A literal dot is not FEN, so it is made unreadable first.
    """
    out = F.replace(placement, F.lit("."), F.lit("?"))
    for n in range(1, 9):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def grid_ok(grid: Column) -> Column:
    """Eight ranks of eight known characters, on an expanded placement."""
    return F.rlike(grid, F.lit(_EIGHT_RANKS))


def fen_valid_viewer(fen: Column) -> Column:
    """Rule of the board viewer: placement and side are enough, the rest is not looked at."""
    ok = grid_ok(expand_ranks(fen_field(fen, 0))) & fen_field(fen, 1).isin("w", "b")
    return F.coalesce(ok, F.lit(False))


def fen_valid_strict(fen: Column) -> Column:
    """Rule for samples: every field present must be well formed."""
    return strict_ok(fen, fen_field(fen, 0), expand_ranks(fen_field(fen, 0)))


def strict_ok(fen: Column, placement: Column, grid: Column) -> Column:
    """The same rule where placement and expanded placement are columns already."""
    ok = (
        grid_ok(grid)
        & ~F.rlike(placement, F.lit("[1-8][1-8]"))
        & F.rlike(F.btrim(fen, F.lit(SPACE)), F.lit(_STRICT_FIELDS))
    )
    return F.coalesce(ok, F.lit(False))


def side_to_move(fen: Column) -> Column:
    """'White' or 'Black'; a FEN without a side field means White."""
    return F.when(fen_field(fen, 1) == "b", "Black").otherwise("White")


def board_string(fen: Column) -> Column:
    """64 characters, a1 b1 .. h8, '.' for an empty square."""
    return F.array_join(F.reverse(F.split(expand_ranks(fen_field(fen, 0)), "/")), "")


def board_text(fen: Column) -> Column:
    """Bordered diagram with Unicode pieces, rank 8 on top."""
    symbols = F.translate(expand_ranks(fen_field(fen, 0)), PIECES + ".", PIECE_SYMBOLS + EMPTY_SYMBOL)
    ranks = F.split(F.regexp_replace(symbols, "([^/])", "|$1"), "/")
    parts: list[Column] = []
    for i in range(8):
        parts += [F.lit(f"{_DASHES}{8 - i} "), F.get(ranks, F.lit(i)), F.lit("|\n")]
    return F.concat(*parts, F.lit(_DASHES + "   a b c d e f g h"))


def square_name(sq: Column) -> Column:
    """0..63 to a1..h8."""
    file = F.substring(F.lit("abcdefgh"), sq % 8 + 1, F.lit(1))
    return F.concat(file, (F.floor(sq / 8) + 1).cast("string"))


def square_index(name: Column) -> Column:
    """a1..h8 to 0..63."""
    return (F.ascii(name) - 97) + 8 * (F.substring(name, 2, 1).cast("int") - 1)


def coord_to_square(row: Column, col: Column) -> Column:
    """Row 0 is rank 8."""
    return F.concat(F.char(F.lit(97) + col), (F.lit(8) - row).cast("string"))


def square_to_row(name: Column) -> Column:
    return F.lit(8) - F.substring(name, 2, 1).cast("int")


def square_to_col(name: Column) -> Column:
    return F.ascii(name) - 97


def square_shade(row: Column, col: Column) -> Column:
    return F.when((row + col) % 2 == 0, "light").otherwise("dark")


def apply_move(board: Column, frm: Column, to: Column) -> Column:
    """Move whatever stands on `frm` to `to` and clear `frm`; nothing else changes."""
    piece = F.substring(board, frm + 1, F.lit(1))
    cleared = F.overlay(board, F.lit("."), frm + 1, F.lit(1))
    return F.overlay(cleared, piece, to + 1, F.lit(1))


def uci_parts(uci: Column) -> Column:
    """Struct of from, to (0..63) and promotion letter; null for anything but a move."""
    pattern = "^([a-h][1-8])([a-h][1-8])([nbrq]?)$"
    frm, to, promo = (F.regexp_extract(uci, pattern, i) for i in (1, 2, 3))
    return F.when(F.rlike(uci, F.lit(pattern)), F.struct(
        square_index(frm).alias("frm"), square_index(to).alias("to"), promo.alias("promo")))
