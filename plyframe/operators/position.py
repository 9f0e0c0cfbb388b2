"""Square sets and king-safety facts of a position, as columns of the position's own row.

Everything is written from the side to move ("own") against the other side ("opp"), with own
pawns moving up. With these columns a move's legality is a filter on integers of the same row:
no join, no shuffle, and no look at any other move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions import bits as b
from plyframe.functions import fen as fenf

# Columns that `with_position` adds.
POSITION_COLUMNS = [
    "white_to_move", "mover_board",
    "own_p", "own_n", "own_b", "own_r", "own_q", "own_k",
    "opp_p", "opp_n", "opp_b", "opp_r", "opp_q", "opp_k",
    "own", "opp", "occ",
    "danger", "check_mask", "pin_v", "pin_h", "pin_d", "pin_a",
    "castle_k", "castle_q", "ep_bit", "ep_from",
]
MAY_BE_NULL = ["mover_board", "ep_from"]

# Piece codes in hexadecimal; 8 marks the black pieces.
_CODES = {"p": 1, "n": 2, "b": 3, "r": 4, "q": 5, "k": 6}
_HEX = "".join(f"{_CODES[p.lower()] + 8 * p.islower():x}" for p in fenf.PIECES) + "0"
_OPPOSITE = {"n": "s", "s": "n", "e": "w", "w": "e", "ne": "sw", "sw": "ne", "nw": "se", "se": "nw"}


def _planes() -> dict[str, str]:
    """One square set per binary digit of the piece codes."""
    return {
        f"_t{1 << digit}": b.union(
            [b.shift(b.pack_nibbles(f"_x{i}", digit), 48 - 16 * i) if i < 3 else b.pack_nibbles("_x3", digit)
             for i in range(4)])
        for digit in range(4)
    }


def _piece_set(piece: str, side: str) -> str:
    code = _CODES[piece]
    planes = [f"_t{n}" if code & n else f"~_t{n}" for n in (1, 2, 4)]
    return " & ".join(["_op" if side == "opp" else "~_op", *planes])


def king_lines(king: str, occ: str, straight: str, diagonal: str) -> dict[str, str]:
    """Per direction: what the attacking sliders see (`s_`), and what the king sees (`k_`).

    Sliders see through the king, so that it cannot hide on the far side of itself.
    """
    sliders = {d: straight if d in b.STRAIGHT else diagonal for d in b.DIRECTIONS}
    seen = {f"s_{d}": b.ray(sliders[d], f"(~{occ} | {king})", d) for d in b.DIRECTIONS}
    return seen | {f"k_{d}": b.ray(king, f"(~{occ})", d) for d in b.DIRECTIONS}


def king_safety(lines: str, own: str, straight: str, diagonal: str, knights_at_king: str,
                pawns_at_king: str, kings_at_king: str, leaper_attacks: list[str]) -> dict[str, str]:
    """Attacked squares, number and squares of the checkers' lines, and pinned pieces by line.

    `lines` is the prefix under which the columns of `king_lines` are found.
    """
    hit = {d: f"({lines}k_{d} & {straight if d in b.STRAIGHT else diagonal})" for d in b.DIRECTIONS}
    leapers = [knights_at_king, pawns_at_king, kings_at_king]

    def pin(*directions: str) -> str:
        return f"{own} & " + b.union([f"({lines}s_{d} & {lines}k_{_OPPOSITE[d]})" for d in directions])

    return {
        "danger": b.union([f"{lines}s_{d}" for d in b.DIRECTIONS] + leaper_attacks),
        "checkers": " + ".join([f"IF({h} <> 0L, 1, 0)" for h in hit.values()]
                               + [f"bit_count({e})" for e in leapers]),
        "lines": b.union([f"IF({h} <> 0L, {lines}k_{d}, 0L)" for d, h in hit.items()] + leapers),
        "pin_v": pin("n", "s"), "pin_h": pin("e", "w"), "pin_d": pin("ne", "sw"), "pin_a": pin("nw", "se"),
    }


def check_mask(checkers: str, lines: str) -> str:
    """Squares where a move of another piece than the king may land."""
    return f"CASE WHEN {checkers} = 0 THEN -1L WHEN {checkers} = 1 THEN {lines} ELSE 0L END"


def _en_passant_from(leaper_checks: str) -> str:
    """Own pawns that may capture en passant.

    Two pawns leave the board at once, so pins do not decide this: the king's lines are redone on
    the board after the capture. Rare, hence behind a test and inside a lambda.
    """
    taken = "shiftrightunsigned(ep_bit, 8)"
    exposed = b.union([
        f"({b.rays('own_k', 'c.empty', b.STRAIGHT)} & _straight)",
        f"({b.rays('own_k', 'c.empty', b.DIAGONAL)} & _diagonal)",
    ])
    return f"""CASE WHEN ep_bit = 0L THEN 0L ELSE aggregate(
        filter(
          transform(
            filter(array({b.step('ep_bit', 'sw')} & own_p, {b.step('ep_bit', 'se')} & own_p), f -> f <> 0L),
            f -> named_struct('frm', f, 'empty', ~((occ & ~(f | {taken})) | ep_bit))),
          c -> {exposed} = 0L AND ({leaper_checks} & ~{taken}) = 0L),
        0L, (acc, c) -> acc | c.frm) END"""


def _castle(letters: str, empty: list[str], path: list[str], rook: str) -> str:
    sets = [b.const(b.squares(*names)) for names in (["e1"], [rook], empty, path)]
    return (
        f"_rights rlike '[{letters}]' AND (own_k & {sets[0]}) <> 0L AND (own_r & {sets[1]}) <> 0L"
        f" AND (occ & {sets[2]}) = 0L AND (danger & {sets[3]}) = 0L"
    )


def present(squares: str) -> str:
    """Whether a square set is not empty, asked through a lambda.

    A projection with a lambda is compiled on its own, in methods of bounded size. Without such
    stops the many steps here would fuse into one method too long for the JVM to compile.
    """
    return f"exists(array({squares}), s -> s <> 0L)"


def fenced(condition: str) -> str:
    """The same condition, but kept out of predicate pushdown.

    A filter on a column computed over many projections would be pushed below all of them by
    substituting their expressions, each of which uses the previous ones several times. The
    partition number makes the column's projection a stop, and is always at least 0.
    """
    return f"(({condition}) AND exists(array(spark_partition_id()), p -> p >= 0))"


def select_sql(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in exprs.items()})


def with_position(df: DataFrame, fen: str = "fen", strict: bool = False) -> DataFrame:
    """Add the columns of POSITION_COLUMNS. A malformed placement, and with `strict` any malformed field, gives an empty
    board, hence no moves.

    The steps are separate projections on purpose: each is referenced several times by the next,
    and generated methods stay below the size the JVM compiles.
    """
    keep = df.columns
    df = df.withColumn("_fields", fenf.fen_fields(F.col(fen)))
    df = df.withColumns({
        "_grid": fenf.expand_ranks(F.get("_fields", F.lit(0))),
        "_black": F.coalesce(F.get("_fields", F.lit(1)) == "b", F.lit(False)),
        "_rights": F.coalesce(F.get("_fields", F.lit(2)), F.lit("-")),
        "_ep": F.coalesce(F.get("_fields", F.lit(3)), F.lit("-")),
    })
    ranks_up = F.array_join(F.reverse(F.split("_grid", "/")), "")
    df = df.withColumns({
        "white_to_move": ~F.col("_black"),
        # The mover's last rank first; black pieces stay in lower case.
        "mover_board": F.when(~(fenf.strict_ok(F.col(fen), F.get("_fields", F.lit(0)), F.col("_grid")) if strict else fenf.grid_ok(F.col("_grid"))), "." * 64)
        .when(F.col("_black"), ranks_up).otherwise(F.replace("_grid", F.lit("/"), F.lit(""))),
        "_rights": F.when(F.col("_black"), F.translate("_rights", "kqahKQAH", "KQAH"))
        .otherwise(F.translate("_rights", "kqah", "")),
    })
    df = df.withColumn("_hex", F.translate("mover_board", fenf.PIECES + ".", _HEX))
    # The board as four numbers of 16 squares, one hexadecimal digit per square. `_hex` is named four times outside the
    # lambda: named once inside, it would be replaced by all that makes it, and that be done for each element.
    parts = ", ".join(f"substr(_hex, {16 * i + 1}, 16)" for i in range(4))
    df = select_sql(df, {"_x": f"transform(array({parts}), x -> CAST(conv(x, 16, -10) AS BIGINT))"})
    df = select_sql(df, {f"_x{i}": f"coalesce(_x[{i}], 0L)" for i in range(4)})
    df = select_sql(df, _planes())
    df = select_sql(df, {"occ": "_t1 | _t2 | _t4", "_op": "IF(white_to_move, _t8, (_t1 | _t2 | _t4) & ~_t8)"})
    df = select_sql(df, {f"{side}_{p}": _piece_set(p, side) for side in ("own", "opp") for p in "pnbrqk"} | {
        "own": "occ & ~_op", "opp": "_op",
        "_straight": "_op & _t4 & ~_t2", "_diagonal": "_op & _t1 & (_t2 | _t4)",
    })
    lines = king_lines("own_k", "occ", "_straight", "_diagonal")
    df = select_sql(df, {f"_{k}": v for k, v in lines.items()} | {
        "ep_bit": "CASE WHEN _ep rlike IF(white_to_move, '^[a-h]6$', '^[a-h]3$')"
                  " THEN shiftleft(1L, 144 - ascii(_ep)) & ~occ ELSE 0L END",
    })
    at_king = [
        f"({b.knight_steps('own_k')} & opp_n)", f"({b.pawn_attacks_up('own_k')} & opp_p)",
        f"({b.king_steps('own_k')} & opp_k)",
    ]
    facts = king_safety(
        "_", "own", "_straight", "_diagonal", *at_king,
        [b.knight_steps("opp_n"), b.pawn_attacks_down("opp_p"), b.king_steps("opp_k")],
    )
    public = ("danger", "pin_v", "pin_h", "pin_d", "pin_a")
    df = select_sql(df, {k if k in public else f"_{k}": v for k, v in facts.items()}
                    | {"ep_from": _en_passant_from(b.union(at_king))})
    df = select_sql(df, {
        "check_mask": check_mask("_checkers", "_lines"),
        "castle_k": _castle("KH", ["f1", "g1"], ["e1", "f1", "g1"], "h1"),
        "castle_q": _castle("QA", ["b1", "c1", "d1"], ["c1", "d1", "e1"], "a1"),
    })
    return df.select(*keep, *POSITION_COLUMNS)


def never_null(positions: DataFrame) -> DataFrame:
    """Positions read from files, which forget what columns are never null: null checks on all of them would make the
    generated methods of what follows too large for the JVM to compile."""
    fixed = {c: kind for c, kind in positions.dtypes if c in POSITION_COLUMNS and c not in MAY_BE_NULL}
    return positions.withColumns({c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in fixed.items()})


# Line masks by square number, as constant arrays: file, rank and the two diagonals.
def _line_table(directions: tuple[str, str]) -> str:
    masks = []
    for sq in range(64):
        mask = 0
        for d in directions:
            n, land = b.DIRECTIONS[d]
            at = 1 << sq
            while at:
                mask |= at
                at = ((at << n) & b.FULL if n > 0 else at >> -n) & land
        masks.append(b.const(mask))
    return f"array({', '.join(masks)})"


LINE_TABLES = {
    "pin_v": _line_table(("n", "s")), "pin_h": _line_table(("e", "w")),
    "pin_d": _line_table(("ne", "sw")), "pin_a": _line_table(("nw", "se")),
}


def with_reach(df: DataFrame, to: str) -> DataFrame:
    """Add what the one-bit set `to` sees along lines and diagonals, as the origin functions need."""
    return select_sql(df, {
        "reach_straight": f"IF({present(to)}, {b.rays(to, '(~occ)', b.STRAIGHT)}, 0L)",
        "reach_diagonal": f"IF({present(to)}, {b.rays(to, '(~occ)', b.DIAGONAL)}, 0L)",
    })


def pseudo_origins(piece: str, to: str) -> str:
    """Set of own squares from which `piece` (a letter P N B R Q K) reaches the one-bit set `to`,
    king safety and en passant aside. Needs `with_reach`."""
    down, down2 = f"shiftrightunsigned({to}, 8)", f"shiftrightunsigned({to}, 16)"
    pawn = f"""(IF(({to} & occ) = 0L,
        ({down} & own_p) | IF(({down} & occ) = 0L, {down2} & own_p & {b.const(b.rank(2))}, 0L), 0L)
        | IF(({to} & opp) <> 0L, {b.pawn_attacks_down(to)} & own_p, 0L))"""
    return f"""IF(({to} & own) <> 0L, 0L, CASE {piece}
        WHEN 'P' THEN {pawn}
        WHEN 'N' THEN {b.knight_steps(to)} & own_n
        WHEN 'B' THEN reach_diagonal & own_b
        WHEN 'R' THEN reach_straight & own_r
        WHEN 'Q' THEN (reach_straight | reach_diagonal) & own_q
        WHEN 'K' THEN {b.king_steps(to)} & own_k
        ELSE 0L END)"""


def safe_origins(piece: str, to: str, to_sq: str) -> str:
    """Origins that keep the own king safe when moving to `to` (square number `to_sq`)."""
    pins = " & ".join(f"~({pin} & ~get({table}, {to_sq}))" for pin, table in LINE_TABLES.items())
    return f"""(CASE WHEN {piece} = 'K' THEN IF(({to} & danger) = 0L, -1L, 0L)
        WHEN ({to} & check_mask) = 0L THEN 0L ELSE {pins} END)"""


def legal_origins(piece: str, to: str, to_sq: str) -> str:
    """Set of own squares from which `piece` can legally move to `to`; castling is not included."""
    return (f"({pseudo_origins(piece, to)} & {safe_origins(piece, to, to_sq)})"
            f" | IF({piece} = 'P' AND {to} = ep_bit, ep_from, 0L)")
