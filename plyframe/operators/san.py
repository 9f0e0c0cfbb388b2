"""Moves as text: decoding UCI, resolving SAN, rendering SAN. All row-local.

The decoders add MOVE_COLUMNS plus `ok`; `with_san` renders from them. Nothing here enumerates
the moves of a position: the question "from which own squares can this piece reach that square
legally" has a closed form (`position.legal_origins`), and answers legality, disambiguation and
uniqueness at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions import bits as b
from plyframe.operators.position import (
    LINE_TABLES,
    check_mask,
    fenced,
    king_lines,
    king_safety,
    legal_origins,
    present,
    select_sql,
    with_reach,
)

# --- fixed values: move notation ----------------------------------------------------------
UCI_PATTERN = "^([a-h][1-8])([a-h][1-8])([a-z]?)$"
SAN_PATTERN = "^([NBKRQ])?([a-h])?([1-8])?[-x]?([a-h][1-8])(?:=?([nbrqkNBRQK]))?[+#]?$"
CASTLE_KING_SIDE = "^(?:O-O|0-0)[+#]?$"
CASTLE_QUEEN_SIDE = "^(?:O-O-O|0-0-0)[+#]?$"
# ------------------------------------------------------------------------------------------

_E1, _G1, _C1 = b.index("e1"), b.index("g1"), b.index("c1")


def _mover_square(name: str) -> str:
    """Text square to the mover's square number; 64 if there is none."""
    return f"CASE WHEN length({name}) = 2 THEN {b.index_sql(name)} ^ IF(white_to_move, 0, 56) ELSE 64 END"


def _square_bit(sq: str) -> str:
    return f"IF({sq} < 64, shiftleft(1L, {sq}), 0L)"


_PIECE_AT = (
    "CASE WHEN ({bit} & own) = 0L THEN '' WHEN ({bit} & own_p) <> 0L THEN 'P' WHEN ({bit} & own_n) <> 0L THEN 'N'"
    " WHEN ({bit} & own_b) <> 0L THEN 'B' WHEN ({bit} & own_r) <> 0L THEN 'R'"
    " WHEN ({bit} & own_q) <> 0L THEN 'Q' ELSE 'K' END"
)

_UCI_OUT = (
    "concat(" + b.name_sql("(frm ^ IF(white_to_move, 0, 56))") + ", "
    + b.name_sql("(`to` ^ IF(white_to_move, 0, 56))") + ", promo)"
)


def _castle_by_squares(frm_bit: str, to_sq: str) -> str:
    """King on its home square sent to the castling square, or onto its own rook."""
    home = f"({frm_bit} & own_k & {b.const(1 << _E1)}) <> 0L"
    return (
        f"CASE WHEN {home} AND {to_sq} IN ({_G1}, {b.index('h1')}) AND castle_k THEN 'K'"
        f" WHEN {home} AND {to_sq} IN ({_C1}, {b.index('a1')}) AND castle_q THEN 'Q' ELSE '' END"
    )


def _finish(df: DataFrame, keep: list[str], castle: str, origin: str, sound: str) -> DataFrame:
    """Settle castling, then write MOVE_COLUMNS. `origin` is a one-bit set, empty if unresolved."""
    df = select_sql(df, {"_castle": castle, "_origin": origin})
    df = select_sql(df, {
        "ok": fenced(f"_castle <> '' OR (_origin <> 0L AND {sound})"),
        "castle": "_castle",
        "frm_bit": f"IF(_castle <> '', {b.const(1 << _E1)}, _origin)",
        "to": f"CASE _castle WHEN 'K' THEN {_G1} WHEN 'Q' THEN {_C1} ELSE _to END",
        "piece": "IF(_castle <> '', 'K', _piece)",
        "promo": "IF(_castle <> '', '', _promo)",
    })
    df = select_sql(df, {
        "to_bit": _square_bit("`to`"), "frm": f"IF(frm_bit = 0L, 64, {b.index_of('frm_bit')})",
    })
    df = select_sql(df, {"uci": f"IF(ok, {_UCI_OUT}, NULL)"})
    return df.select(*keep, "ok", "piece", "frm", "to", "frm_bit", "to_bit", "promo", "castle", "uci")


_PROMOTION_FITS = (
    f"IF(_piece = 'P' AND (_to_bit & {b.const(b.rank(8))}) <> 0L, _promo IN ('q', 'r', 'b', 'n'), _promo = '')"
)


def with_uci_move(df: DataFrame, uci: str) -> DataFrame:
    """Decode column `uci` on a frame from `with_position`; `ok` says whether the move is legal.

    Castling is accepted both as the king's two-square move and as king onto own rook.
    """
    keep = df.columns if uci != "uci" else [c for c in df.columns if c != "uci"]
    text = F.coalesce(F.col(uci), F.lit(""))
    df = df.withColumns({
        "_a": F.regexp_extract(text, UCI_PATTERN, 1), "_b": F.regexp_extract(text, UCI_PATTERN, 2),
        "_promo": F.regexp_extract(text, UCI_PATTERN, 3),
    })
    df = select_sql(df, {"_from": _mover_square("_a"), "_to": _mover_square("_b")})
    df = select_sql(df, {"_from_bit": _square_bit("_from"), "_to_bit": _square_bit("_to")})
    df = with_reach(select_sql(df, {"_piece": _PIECE_AT.format(bit="_from_bit")}), "_to_bit")
    df = select_sql(df, {"_set": legal_origins("_piece", "_to_bit", "_to")})
    return _finish(df, keep, f"IF(_promo = '', {_castle_by_squares('_from_bit', '_to')}, '')",
                   "_set & _from_bit", _PROMOTION_FITS)


def with_san_move(df: DataFrame, text: str, lenient: bool = False) -> DataFrame:
    """Resolve the SAN in column `text` to the one legal move it can mean; `ok` is false if there is
    none or more than one.

    `lenient` adds the case-insensitive second try: a text that did not resolve is accepted when it
    equals the SAN of a legal move but for upper and lower case and check marks. A text in no known
    spelling is first put into the usual one. After that only a leading "b"/"B" is open, so its
    other reading is resolved too. The rendered SAN must then equal the text (done in `with_san`,
    by column `must_equal`).
    """
    keep = df.columns
    given = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_given", given)
    known = F.rlike("_given", F.lit(f"{SAN_PATTERN}|{CASTLE_KING_SIDE}|{CASTLE_QUEEN_SIDE}"))
    low = F.lower("_given")
    usual = F.when(F.rlike(low, F.lit("^o-o")), F.upper("_given")).otherwise(
        F.concat(F.when(F.rlike(low, F.lit("^[nrqk]")), F.upper(F.left(low, F.lit(1)))).otherwise(F.left(low, F.lit(1))),
                 F.substr(low, F.lit(2))))
    df = df.withColumn("_text", F.when(known, F.col("_given")).otherwise(usual) if lenient else F.col("_given"))
    df = df.withColumns({f"_g{i}": F.regexp_extract("_text", SAN_PATTERN, i) for i in range(1, 6)})
    df = select_sql(df, {
        "_to": _mover_square("_g4"), "_promo": "lower(_g5)",
        "_full": "_g1 = '' AND _g2 <> '' AND _g3 <> ''",
        "_from": f"CASE WHEN _g2 <> '' AND _g3 <> '' THEN {_mover_square('concat(_g2, _g3)')} ELSE 64 END",
    })
    df = select_sql(df, {"_to_bit": _square_bit("_to"), "_from_bit": _square_bit("_from")})
    df = select_sql(df, {
        "_piece": f"CASE WHEN _g1 <> '' THEN _g1 WHEN _full THEN {_PIECE_AT.format(bit='_from_bit')} ELSE 'P' END",
        # Squares the move may start from, by what the text says of file and rank.
        "_file": f"CASE WHEN _g2 <> '' THEN get({LINE_TABLES['pin_v']}, 104 - ascii(_g2))"
                 f" WHEN _g1 = '' THEN coalesce(get({LINE_TABLES['pin_v']}, _to), 0L) ELSE -1L END",
        "_rank": f"CASE WHEN _g3 <> '' THEN get({LINE_TABLES['pin_h']},"
                 f" (8 * (ascii(_g3) - 49)) ^ IF(white_to_move, 0, 56)) ELSE -1L END",
        "_other": "CASE WHEN _text LIKE 'b%' AND _g1 = '' AND _g3 = '' THEN 'B'"
                  " WHEN _text LIKE 'B%' AND _g2 = '' AND _g3 = '' THEN 'P' ELSE '' END",
    })
    df = with_reach(df, "_to_bit")
    df = select_sql(df, {
        "_set": legal_origins("_piece", "_to_bit", "_to"),
        "_set2": legal_origins("_other", "_to_bit", "_to") if lenient else "0L",
    })
    b_file = f"get({LINE_TABLES['pin_v']}, {b.index('b1')})"
    df = select_sql(df, {
        "_set": "_set & _file & _rank",
        "_set2": f"IF(_other = 'P', _set2 & {b_file}, _set2)",
    })
    df = select_sql(df, {
        "_first": f"bit_count(_set) = 1 AND {_PROMOTION_FITS}",
        "_second": "_other <> '' AND bit_count(_set2) = 1",
    })
    castle = (
        f"CASE WHEN _text RLIKE '{CASTLE_KING_SIDE}' THEN IF(castle_k, 'K', '')"
        f" WHEN _text RLIKE '{CASTLE_QUEEN_SIDE}' THEN IF(castle_q, 'Q', '')"
        f" WHEN _full AND _promo = '' THEN {_castle_by_squares('_from_bit', '_to')} ELSE '' END"
    )
    df = select_sql(df, {
        "must_equal": "CASE WHEN _text <> _given OR (NOT _first AND _second)"
                      " THEN lower(regexp_replace(_text, '[+#]', '')) END",
        "_origin": "CASE WHEN _first THEN _set WHEN _second THEN _set2 ELSE 0L END",
        "_piece": "IF(NOT _first AND _second, _other, _piece)",
    })
    return _finish(df, [*keep, "must_equal"] if lenient else keep, castle, "_origin", _PROMOTION_FITS)


def _after_move() -> dict[str, str]:
    """Both sides' sets after the move: `_m_` the mover's, `_q_` the opponent's."""
    rook_from = f"(CASE castle WHEN 'K' THEN {b.const(b.squares('h1'))} WHEN 'Q' THEN {b.const(b.squares('a1'))} ELSE 0L END)"
    rook_to = f"(CASE castle WHEN 'K' THEN {b.const(b.squares('f1'))} WHEN 'Q' THEN {b.const(b.squares('d1'))} ELSE 0L END)"
    left = f"~(frm_bit | {rook_from})"

    def mine(sets: str, letters: str) -> str:
        return f"(({sets}) & {left}) | IF(contains('{letters}', _landed), to_bit, 0L)"

    theirs = {f"_q_{p}": f"opp_{p} & ~(to_bit | _gone)" for p in "pnbrq"}
    return theirs | {
        "_q": "opp & ~(to_bit | _gone)",
        "_m_occ": f"((occ & {left} & ~_gone) | to_bit | {rook_to})",
        "_m_straight": mine("own_r | own_q", "RQ") + f" | {rook_to}",
        "_m_diagonal": mine("own_b | own_q", "BQ"),
        "_m_n": mine("own_n", "N"), "_m_p": mine("own_p", "P"), "_m_k": mine("own_k", "K"),
    }


def _check() -> str:
    return b.union([
        f"({b.rays('opp_k', '(~_m_occ)', b.STRAIGHT)} & _m_straight)",
        f"({b.rays('opp_k', '(~_m_occ)', b.DIAGONAL)} & _m_diagonal)",
        f"({b.knight_steps('opp_k')} & _m_n)",
        f"({b.pawn_attacks_down('opp_k')} & _m_p)",
    ]) + " <> 0L AND " + present("opp_k")


def _reply_lines() -> dict[str, str]:
    """What the mover's sliders and the opponent's king see after the move."""
    return {f"_y_{k}": v for k, v in king_lines("opp_k", "_m_occ", "_m_straight", "_m_diagonal").items()}


def _with_reply(df: DataFrame) -> DataFrame:
    """Add `_reply`: whether the side in check has any legal move. Of use for checking moves only. Needs `_reply_lines`.

    The sets are columns, since an expression inside a lambda is not compiled: written in one, they took most of the time.
    """
    facts = king_safety(
        "_y_", "_q", "_m_straight", "_m_diagonal",
        f"({b.knight_steps('opp_k')} & _m_n)", f"({b.pawn_attacks_down('opp_k')} & _m_p)", "0L",
        [b.knight_steps("_m_n"), b.pawn_attacks_up("_m_p"), b.king_steps("_m_k")],
    )
    df = select_sql(df, {f"_z_{k}": v for k, v in facts.items()} | {"_king": present("opp_k")})
    df = select_sql(df, {
        "_free": "~(_z_pin_v | _z_pin_h | _z_pin_d | _z_pin_a)", "_target": check_mask("_z_checkers", "_z_lines"),
        "_flight": f"{b.king_steps('opp_k')} & ~_q & ~_z_danger",
    })
    pushed = "(shiftrightunsigned(_q_p & _free, 8) & ~_m_occ)"
    pushed2 = f"(shiftrightunsigned({pushed} & {b.const(b.rank(6))}, 8) & ~_m_occ)"
    blocks = b.union([
        b.rays("((_q_r | _q_q) & _free)", "(~_m_occ)", b.STRAIGHT),
        b.rays("((_q_b | _q_q) & _free)", "(~_m_occ)", b.DIAGONAL),
        b.knight_steps("(_q_n & _free)"),
        f"({b.pawn_attacks_down('(_q_p & _free)')} & _m_occ & ~_q)",
        pushed, pushed2,
    ])
    df = select_sql(df, {"_blocks": f"{blocks} & _target & ~_q"})
    # Rare, hence behind a test and inside a lambda.
    lifted = "(~(_m_occ & ~to_bit))"
    en_passant = f"""(piece = 'P' AND shiftleft(frm_bit, 16) = to_bit AND (to_bit & _target) <> 0L
        AND (({b.step('to_bit', 'e')} | {b.step('to_bit', 'w')}) & _q_p & free) <> 0L
        AND (({b.rays('opp_k', lifted, b.STRAIGHT)} & _m_straight)
           | ({b.rays('opp_k', lifted, b.DIAGONAL)} & _m_diagonal)) = 0L)"""
    return select_sql(df, {"_reply": f"IF(_check, _flight <> 0L OR _blocks <> 0L OR exists(array(_free), free -> {en_passant}), true)"})


def with_san(df: DataFrame, out: str = "san") -> DataFrame:
    """Add the SAN of the move in MOVE_COLUMNS, null where `ok` is false. Needs the position columns.

    If column `must_equal` is present and set, the SAN must equal it but for case and check marks.
    """
    keep = df.columns
    ok = "ok" if "ok" in keep else "true"
    if "must_equal" in keep:
        same = "(must_equal IS NULL OR lower(regexp_replace(_san, '[+#]', '')) = must_equal)"
    else:
        same = "true"
    df = with_reach(df, "to_bit")
    df = select_sql(df, {
        "_others": f"IF(piece IN ('P', 'K'), 0L, ({legal_origins('piece', 'to_bit', '`to`')}) & ~frm_bit)",
        "_gone": "IF(piece = 'P' AND to_bit = ep_bit AND shiftrightunsigned(to_bit, 8) <> frm_bit,"
                 " shiftrightunsigned(ep_bit, 8), 0L)",
        "_landed": "IF(promo = '', piece, upper(promo))",
    })
    df = select_sql(df, _after_move())
    df = select_sql(df, {"_check": _check()} | _reply_lines())
    file_of, rank_of = (f"get({LINE_TABLES[p]}, frm)" for p in ("pin_v", "pin_h"))
    takes = "((to_bit & opp) <> 0L OR _gone <> 0L)"
    df = select_sql(df, {"_san": f"""CASE WHEN NOT {ok} THEN NULL WHEN castle = 'K' THEN 'O-O' WHEN castle = 'Q' THEN 'O-O-O'
        ELSE concat(
          CASE WHEN piece = 'P' THEN IF({takes}, left(uci, 1), '')
               WHEN _others = 0L THEN piece
               WHEN (_others & {file_of}) = 0L THEN concat(piece, left(uci, 1))
               WHEN (_others & {rank_of}) = 0L THEN concat(piece, substr(uci, 2, 1))
               ELSE concat(piece, left(uci, 2)) END,
          IF({takes}, 'x', ''), substr(uci, 3, 2), IF(promo = '', '', concat('=', upper(promo)))) END"""})
    df = _with_reply(df)
    mark = f"CASE WHEN NOT ({ok}) OR NOT _check THEN '' WHEN _reply THEN '+' ELSE '#' END"
    df = select_sql(df, {out: f"IF({fenced(same)}, concat(_san, {mark}), NULL)"})
    return df.select(*keep, out)
