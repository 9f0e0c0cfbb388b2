"""An independent move generator in plain SQL, for the oracles only.

It works the slow, obvious way: walk every ray square by square, make the move on a board string,
and see whether the other side can then take the king. No part of it is shared with the library.
"""

from __future__ import annotations

from plyframe.queries.fixtures import SQL_FENS

STEPS = """steps(pc, df, dr, reach) AS (VALUES
 ('N',1,2,1),('N',2,1,1),('N',2,-1,1),('N',1,-2,1),('N',-1,-2,1),('N',-2,-1,1),('N',-2,1,1),('N',-1,2,1),
 ('B',1,1,7),('B',1,-1,7),('B',-1,1,7),('B',-1,-1,7),('R',1,0,7),('R',-1,0,7),('R',0,1,7),('R',0,-1,7),
 ('Q',1,1,7),('Q',1,-1,7),('Q',-1,1,7),('Q',-1,-1,7),('Q',1,0,7),('Q',-1,0,7),('Q',0,1,7),('Q',0,-1,7),
 ('K',1,1,1),('K',1,-1,1),('K',-1,1,1),('K',-1,-1,1),('K',1,0,1),('K',-1,0,1),('K',0,1,1),('K',0,-1,1))"""


def sq(expr: str) -> str:
    """Square number (a1 = 0) to text."""
    return f"(chr(CAST(97 + ({expr}) % 8 AS INT)) || CAST(1 + ({expr}) // 8 AS VARCHAR))"


def put(board: str, at: str, what: str) -> str:
    return f"(left({board}, CAST({at} AS INT)) || {what} || substr({board}, CAST({at} AS INT) + 2))"


def pseudo(p: str, src: str) -> str:
    """CTEs ending in {p}_pm(pid, white, board, frm, dst, pc, ep): simple-rules moves of `src`
    (pid, white, board, ep)."""
    at = lambda e: f"substr(board, CAST({e} AS INT) + 1, 1)"
    enemy = lambda e: f"({at(e)} <> '.' AND ({at(e)} = upper({at(e)})) <> white)"
    return f"""{p}_own AS (
  SELECT pid, white, board, ep, g.i AS frm, upper({at('g.i')}) AS pc, CASE WHEN white THEN 8 ELSE -8 END AS up
  FROM {src} CROSS JOIN generate_series(0, 63) AS g(i)
  WHERE {at('g.i')} <> '.' AND ({at('g.i')} = upper({at('g.i')})) = white),
{p}_ray AS (
  SELECT o.*, s.df, s.dr, n.n, frm + s.df * n.n + 8 * s.dr * n.n AS dst
  FROM {p}_own o JOIN steps s ON s.pc = o.pc CROSS JOIN generate_series(1, 7) AS n(n)
  WHERE n.n <= s.reach AND frm % 8 + s.df * n.n BETWEEN 0 AND 7 AND frm // 8 + s.dr * n.n BETWEEN 0 AND 7),
{p}_stop AS (
  SELECT *, min(CASE WHEN {at('dst')} <> '.' THEN n END) OVER (PARTITION BY pid, frm, df, dr) AS stop FROM {p}_ray),
{p}_pm AS MATERIALIZED (
  SELECT pid, white, board, frm, dst, pc, false AS ep FROM {p}_stop
  WHERE stop IS NULL OR n < stop OR (n = stop AND {enemy('dst')})
  UNION ALL SELECT pid, white, board, frm, frm + up, pc, false FROM {p}_own
  WHERE pc = 'P' AND frm + up BETWEEN 0 AND 63 AND {at('frm + up')} = '.'
  UNION ALL SELECT pid, white, board, frm, frm + 2 * up, pc, false FROM {p}_own
  WHERE pc = 'P' AND frm // 8 = CASE WHEN white THEN 1 ELSE 6 END AND {at('frm + up')} = '.' AND {at('frm + 2 * up')} = '.'
  UNION ALL SELECT pid, white, board, frm, frm + up + c, pc, {at('frm + up + c')} = '.' FROM {p}_own
  CROSS JOIN (VALUES (-1), (1)) AS side(c)
  WHERE pc = 'P' AND frm + up BETWEEN 0 AND 63 AND frm % 8 + c BETWEEN 0 AND 7
    AND ({enemy('frm + up + c')} OR (frm + up + c = ep AND {at('frm + up + c')} = '.')))"""


def legal(p: str, src: str, castling: bool) -> str:
    """CTEs ending in {p}_legal(pid, white, mid, frm, dst, pc, promo, castle, takes, after, next_ep).
    `src` has pid, white, board, ep and, with `castling`, rights."""
    own = "CASE WHEN white THEN pc ELSE lower(pc) END"
    landed = f"CASE WHEN promo = '' THEN {own} WHEN white THEN upper(promo) ELSE promo END"
    moved = put(put("board", "frm", "'.'"), "dst", f"({landed})")
    taken = put(moved, "CASE WHEN white THEN dst - 8 ELSE dst + 8 END", "'.'")
    king = "CASE WHEN white THEN 'K' ELSE 'k' END"
    rook = "CASE WHEN white THEN 'R' ELSE 'r' END"
    if castling:
        home = "CASE WHEN white THEN 0 ELSE 56 END"
        castle = f""",
{p}_cc AS (
  SELECT s.pid, s.white, s.board, c.*, {home} AS home FROM {src} s
  CROSS JOIN (VALUES ('K', 6, 7, 5, '..', 5), ('Q', 2, 0, 3, '...', 1)) AS c(castle, kto, rfrom, rto, gap, gap_at)
  WHERE contains(rights, CASE WHEN white THEN castle ELSE lower(castle) END)
    AND substr(board, 5 + {home}, 1) = {king} AND substr(board, 1 + rfrom + {home}, 1) = {rook}
    AND substr(board, 1 + gap_at + {home}, length(gap)) = gap),
{p}_cpath AS (
  SELECT concat(pid, ':', castle) AS mid, NOT white AS white, -1 AS ep,
    {put(put('board', 'home + 4', "'.'"), 'home + 4 + d * CASE castle WHEN ' + "'K' THEN 1 ELSE -1 END", f'({king})')} AS board
  FROM {p}_cc CROSS JOIN generate_series(0, 2) AS g(d))"""
        castle_after = put(put(put(put("board", "home + 4", "'.'"), "home + kto", f"({king})"), "home + rfrom", "'.'"),
                           "home + rto", f"({rook})")
        castle_test = f" UNION ALL SELECT mid, white, board, ep FROM {p}_cpath"
        castle_rows = f"""
  UNION ALL SELECT pid, white, concat(pid, ':', castle), home + 4, home + kto, 'K', '', castle, false, {castle_after}, -1
  FROM {p}_cc WHERE concat(pid, ':', castle) NOT IN (SELECT mid FROM {p}_bad)"""
    else:
        castle = castle_test = castle_rows = ""
    return pseudo(p, src) + f""",
{p}_made AS MATERIALIZED (
  SELECT pid, white, concat(pid, ':', frm, ':', dst, ':', promo) AS mid, frm, dst, pc, promo,
    ep OR substr(board, CAST(dst AS INT) + 1, 1) <> '.' AS takes, CASE WHEN ep THEN {taken} ELSE {moved} END AS after,
    CASE WHEN pc = 'P' AND abs(dst - frm) = 16 THEN (dst + frm) // 2 ELSE -1 END AS next_ep
  FROM {p}_pm JOIN (VALUES ('', false), ('q', true), ('r', true), ('b', true), ('n', true)) AS pr(promo, last)
    ON last = (pc = 'P' AND dst // 8 IN (0, 7))){castle},
{p}_test AS (SELECT mid AS pid, NOT white AS white, after AS board, -1 AS ep FROM {p}_made{castle_test}),
{pseudo(p + 'r', p + '_test')},
{p}_bad AS (SELECT DISTINCT pid AS mid FROM {p}r_pm WHERE upper(substr(board, CAST(dst AS INT) + 1, 1)) = 'K'),
{p}_legal AS MATERIALIZED (
  SELECT pid, white, mid, frm, dst, pc, promo, '' AS castle, takes, after, next_ep FROM {p}_made
  WHERE mid NOT IN (SELECT mid FROM {p}_bad){castle_rows})"""


# The valid literal positions as board strings.
EXPANDED = "split_part(fen, ' ', 1)"
for _n in range(1, 9):
    EXPANDED = f"replace({EXPANDED}, '{_n}', '{'.' * _n}')"
BASE = STEPS + ", " + SQL_FENS + f""",
base AS MATERIALIZED (
  SELECT CAST(k AS VARCHAR) AS pid, k, split_part(fen, ' ', 2) = 'w' AS white, split_part(fen, ' ', 3) AS rights,
    array_to_string(list_reverse(string_split({EXPANDED}, '/')), '') AS board,
    CASE WHEN length(split_part(fen, ' ', 4)) = 2
         THEN ascii(split_part(fen, ' ', 4)) - 97 + 8 * (ascii(substr(split_part(fen, ' ', 4), 2, 1)) - 49) ELSE -1 END AS ep
  FROM fx_fens WHERE k < 10)"""
LEGAL = BASE + ", " + legal("a", "base", castling=True)


def san(p: str) -> str:
    """CTEs ending in {p}_san(k, uci, san) from {p}_legal. A move checks if the mover could now take the king; it mates if
    no legal reply is left."""
    return f"""{p}_moved AS (SELECT mid AS pid, white, after AS board, -1 AS ep FROM {p}_legal),
{pseudo(p + 'c', p + '_moved')},
{p}_check AS (SELECT DISTINCT pid AS mid FROM {p}c_pm WHERE upper(substr(board, CAST(dst AS INT) + 1, 1)) = 'K'),
{p}_reply AS (SELECT mid AS pid, NOT white AS white, after AS board, next_ep AS ep FROM {p}_legal WHERE mid IN (SELECT mid FROM {p}_check)),
{legal(p + 'm', p + '_reply', castling=False)},
{p}_rivals AS (
  SELECT *, count(*) OVER (PARTITION BY pid, pc, dst) - 1 AS rivals,
    count(*) OVER (PARTITION BY pid, pc, dst, frm % 8) - 1 AS on_file,
    count(*) OVER (PARTITION BY pid, pc, dst, frm // 8) - 1 AS on_rank
  FROM {p}_legal),
{p}_san AS MATERIALIZED (
  SELECT CAST(pid AS INT) AS k, {sq('frm')} || {sq('dst')} || promo AS uci,
    CASE castle WHEN 'K' THEN 'O-O' WHEN 'Q' THEN 'O-O-O' ELSE
      CASE WHEN pc = 'P' THEN CASE WHEN takes THEN left({sq('frm')}, 1) ELSE '' END
           WHEN pc = 'K' OR rivals = 0 THEN pc WHEN on_file = 0 THEN pc || left({sq('frm')}, 1)
           WHEN on_rank = 0 THEN pc || substr({sq('frm')}, 2, 1) ELSE pc || {sq('frm')} END
      || CASE WHEN takes THEN 'x' ELSE '' END || {sq('dst')} || CASE WHEN promo = '' THEN '' ELSE '=' || upper(promo) END
    END || CASE WHEN mid NOT IN (SELECT mid FROM {p}_check) THEN ''
                WHEN mid IN (SELECT pid FROM {p}m_legal) THEN '+' ELSE '#' END AS san
  FROM {p}_rivals)"""


SAN = LEGAL + ",\n" + san("a")
