"""Queries over boards and moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.functions import fen as fenf
from plyframe.operators import moves as mv
from plyframe.operators import legality, viewer
from plyframe.operators.replies import resolve_san
from plyframe.operators.san import with_san
from plyframe.queries import chess_sql as cs
from plyframe.queries import fixtures as fx
from plyframe.queries.registry import query

# FEN texts with faults, one kind per customer number.
_FEN_TEXT = """CASE o_custkey % 7 WHEN 0 THEN fen WHEN 1 THEN split_part(fen, ' ', 1) WHEN 2 THEN replace(fen, ' w ', ' x ')
  WHEN 3 THEN replace(fen, '8', '9') WHEN 4 THEN concat('  ', fen, ' ') WHEN 5 THEN replace(fen, '8', '44') ELSE replace(fen, '8', '.') END"""
_EXPAND = "placement"
for _n in range(1, 9):
    _EXPAND = f"replace({_EXPAND}, '{_n}', '{'#' * _n}')"
_GRID_OK = f"regexp_full_match({_EXPAND}, '[#PNBRQKpnbrqk]{{8}}(/[#PNBRQKpnbrqk]{{8}}){{7}}')"


@query("fen_validate", f"""WITH {fx.SQL_POSITIONS}, texts AS (SELECT pos_id, {_FEN_TEXT} AS text FROM fx_positions),
parts AS (SELECT *, split_part(trim(text), ' ', 1) AS placement, split_part(trim(text), ' ', 2) AS side FROM texts)
SELECT pos_id, text, {_GRID_OK} AND side IN ('w', 'b') AS viewer_ok,
  {_GRID_OK} AND side IN ('w', 'b', '') AND NOT regexp_matches(placement, '[1-8][1-8]') AS strict_ok FROM parts""")
def fen_validate(spark, sf):
    rows = fx.positions(spark, sf, "o_custkey").select("pos_id", F.expr(_FEN_TEXT).alias("text"))
    return rows.select("pos_id", "text", fenf.fen_valid_viewer(F.col("text")).alias("viewer_ok"),
                       fenf.fen_valid_strict(F.col("text")).alias("strict_ok"))


@query("board_squares", f"""WITH {fx.SQL_SCATTER} SELECT pos_id, sq, piece, lower(piece) AS type,
  CASE WHEN upper(piece) = piece THEN 'w' ELSE 'b' END AS color FROM fx_scatter""")
def board_squares(spark, sf):
    boards = fx.scatter(spark, sf).select("pos_id", fenf.board_string(F.col("fen")).alias("board"))
    return viewer.board_squares(boards, "pos_id").withColumn("sq", F.col("sq").cast("bigint"))


_SQUARES = """FROM (SELECT l_orderkey AS pos_id, l_linenumber AS line, CAST(7 - l_partkey % 64 // 8 AS INT) AS "row",
  CAST(l_partkey % 8 AS INT) AS col FROM lineitem)"""


def _squares(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pos_id"), F.col("l_linenumber").alias("line"),
        F.expr("CAST(7 - l_partkey % 64 DIV 8 AS INT)").alias("row"), F.expr("CAST(l_partkey % 8 AS INT)").alias("col"))


@query("square_coords", f"""SELECT pos_id, line, substr('abcdefgh', col + 1, 1) || CAST(8 - "row" AS VARCHAR) AS square,
  "row", col {_SQUARES}""")
def square_coords(spark, sf):
    named = _squares(spark, sf).select("pos_id", "line", fenf.coord_to_square(F.col("row"), F.col("col")).alias("square"))
    return named.select("pos_id", "line", "square", fenf.square_to_row(F.col("square")).alias("row"),
                        fenf.square_to_col(F.col("square")).alias("col"))


@query("square_shade", f"""SELECT pos_id, line, "row", col, CASE WHEN ("row" + col) % 2 = 0 THEN 'light' ELSE 'dark' END AS shade {_SQUARES}""")
def square_shade(spark, sf):
    return _squares(spark, sf).select("*", fenf.square_shade(F.col("row"), F.col("col")).alias("shade"))


_PSEUDO = f"{cs.STEPS}, {fx.SQL_SCATTER}, src AS (SELECT pos_id AS pid, white, board, -1 AS ep FROM fx_boards), {cs.pseudo('s', 'src')}"
_UCI = f"{cs.sq('frm')} || {cs.sq('dst')}"


def _pseudo_query(name: str, pieces: str) -> None:
    listed = ", ".join(f"'{p}'" for p in pieces)

    @query(name, f"""WITH {_PSEUDO} SELECT pid AS pos_id, pc AS piece, {_UCI} AS uci,
      substr(board, CAST(dst AS INT) + 1, 1) <> '.' AS is_capture FROM s_pm WHERE pc IN ({listed})""")
    def run(spark, sf):
        return mv.pseudo_legal_moves(fx.scatter(spark, sf), pieces=pieces).select("pos_id", "piece", "uci", "is_capture")


_pseudo_query("pawn_moves", "P")
_pseudo_query("knight_moves", "N")
_pseudo_query("sliding_moves", "BRQ")
_pseudo_query("king_moves", "K")
_pseudo_query("pseudo_legal_moves", "PNBRQK")


@query("piece_mobility", f"WITH {_PSEUDO} SELECT pc AS piece, count(*) AS n, count(DISTINCT pid) AS boards FROM s_pm GROUP BY pc")
def piece_mobility(spark, sf):
    moves = mv.pseudo_legal_moves(fx.scatter(spark, sf))
    per_board = moves.groupBy("piece", "pos_id").agg(F.count("*").alias("n"))
    return per_board.groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("boards"))


@query("piece_destinations", f"""WITH {_PSEUDO} SELECT pid AS pos_id, {cs.sq('frm')} AS from_name, {cs.sq('dst')} AS to_name
FROM s_pm WHERE frm = (SELECT min(sq) FROM fx_scatter f WHERE f.pos_id = s_pm.pid AND (f.piece = upper(f.piece)) = s_pm.white)""")
def piece_destinations(spark, sf):
    # The chosen piece is the mover's first one from a1 on.
    board = fenf.board_string(F.col("fen"))
    first = F.when(F.contains("fen", F.lit(" w")), F.regexp_instr(board, F.lit("[A-Z]"))).otherwise(
        F.regexp_instr(board, F.lit("[a-z]")))
    return viewer.piece_destinations(fx.scatter(spark, sf), "pos_id", fenf.square_name(first - 1))


@query("legal_moves", f"""WITH {cs.LEGAL}
SELECT o.o_orderkey AS pos_id, {_UCI} || promo AS uci FROM orders o JOIN a_legal ON CAST(a_legal.pid AS INT) = o.o_orderkey % 12""")
def legal_moves(spark, sf):
    return mv.legal_moves(fx.positions(spark, sf)).select("pos_id", "uci")


# Strewn boards with one king a side, set by the position's number, no castling, and no pawns on the last ranks.
_KINGS = f"""kings AS (SELECT pid, white, {cs.put(cs.put('board', 'wk', "'K'"), 'bk', "'k'")} AS board, ep FROM (
  SELECT pid, white, ep, CAST(pid AS BIGINT) % 8 AS wk, 56 + CAST(pid AS BIGINT) // 8 % 8 AS bk,
    translate(left(board, 8), 'KkPp', '..Nn') || translate(substr(board, 9, 48), 'Kk', '..') || translate(substr(board, 57), 'KkPp', '..Nn') AS board
  FROM src)),
{cs.legal('k', 'kings', castling=False)}"""


def _kings(spark, sf):
    board = fenf.board_string(F.col("fen"))
    rows = fx.scatter(spark, sf).select("pos_id", F.split("fen", " ")[1].alias("side"), board.alias("b"))
    rows = rows.select("pos_id", "side", F.expr(
        "concat(translate(left(b, 8), 'KkPp', '..Nn'), translate(substr(b, 9, 48), 'Kk', '..'), translate(substr(b, 57), 'KkPp', '..Nn'))").alias("b"))
    rows = rows.select("pos_id", "side", F.expr(
        "overlay(overlay(b PLACING 'K' FROM CAST(pos_id % 8 + 1 AS INT)) PLACING 'k' FROM CAST(57 + pos_id DIV 8 % 8 AS INT))").alias("b"))
    # `b` is named eight times: named once inside a lambda, it would be replaced by all that makes it, for each rank
    ranks = F.concat_ws("/", *(F.substring("b", r * 8 + 1, 8) for r in range(7, -1, -1)))
    for n in range(8, 0, -1):
        ranks = F.replace(ranks, F.lit("." * n), F.lit(str(n)))
    return rows.select("pos_id", F.concat(ranks, F.lit(" "), "side", F.lit(" - -")).alias("fen"))


@query("legal_moves_strewn", f"WITH {cs.STEPS}, {fx.SQL_SCATTER}, src AS (SELECT pos_id AS pid, white, board, -1 AS ep FROM fx_boards), {_KINGS} SELECT CAST(pid AS BIGINT) AS pos_id, {_UCI} || promo AS uci FROM k_legal")
def legal_moves_strewn(spark, sf):
    return mv.legal_moves(_kings(spark, sf)).select("pos_id", "uci")


@query("legality_bitmap", f"""WITH {cs.STEPS}, {fx.SQL_SCATTER}, src AS (SELECT pos_id AS pid, white, board, -1 AS ep FROM fx_boards), {_KINGS}
SELECT CAST(pid AS BIGINT) AS pos_id, CAST(frm AS INT) AS from_sq, count(*) AS n_to, CAST(sum(CASE WHEN dst = 63
  THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(dst AS INT) END) AS BIGINT) AS bits
FROM (SELECT DISTINCT pid, frm, dst FROM k_legal) GROUP BY pid, frm""")
def legality_bitmap(spark, sf):
    rows = legality.with_legality(_kings(spark, sf)).select("pos_id", F.posexplode("bits").alias("from_sq", "bits"))
    return rows.where("bits <> 0").select("pos_id", "from_sq", F.bit_count("bits").cast("long").alias("n_to"), "bits")


@query("san_render_strewn", f"""WITH {cs.STEPS}, {fx.SQL_SCATTER}, src AS (SELECT pos_id AS pid, white, board, -1 AS ep FROM fx_boards), {_KINGS},
{cs.san('k')} SELECT CAST(k AS BIGINT) AS pos_id, uci, san FROM k_san
WHERE substr(uci, 3, 2) <> CASE WHEN k % 2 = 0 THEN substr('abcdefgh', k // 8 % 8 + 1, 1) || '8' ELSE substr('abcdefgh', k % 8 + 1, 1) || '1' END""")
def san_render_strewn(spark, sf):
    """Moves that would take a king are left out: strewn boards have some, games have none."""
    moves = with_san(mv.legal_moves(_kings(spark, sf), keep_position=True)).select("pos_id", "uci", "san")
    return moves.where("""substr(uci, 3, 2) <> IF(pos_id % 2 = 0, concat(substr('abcdefgh', CAST(pos_id DIV 8 % 8 + 1 AS INT), 1), '8'),
      concat(substr('abcdefgh', CAST(pos_id % 8 + 1 AS INT), 1), '1'))""")


@query("san_render", f"WITH {cs.SAN} SELECT o.o_orderkey AS pos_id, uci, san FROM orders o JOIN a_san ON a_san.k = o.o_orderkey % 12")
def san_render(spark, sf):
    return with_san(mv.legal_moves(fx.positions(spark, sf), keep_position=True)).select("pos_id", "uci", "san")


_ASKED = """asked AS (SELECT p.pos_id, p.o_custkey, p.fen, m.uci, m.san FROM fx_positions p
  JOIN fx_moves m ON m.k = p.k AND m.j = (p.pos_id // 12) % 6)"""


def _asked(spark, sf):
    return fx.positions(spark, sf, "ucis", "sans", "o_custkey").select(
        "pos_id", "fen", "o_custkey", F.expr("ucis[CAST((pos_id DIV 12) % 6 AS INT)]").alias("uci"),
        F.expr("sans[CAST((pos_id DIV 12) % 6 AS INT)]").alias("san"))


@query("san_resolve", f"""WITH {fx.SQL_POSITIONS}, {fx.SQL_MOVES}, {_ASKED}
SELECT pos_id, CASE WHEN o_custkey % 5 < 4 THEN san END AS resolved FROM asked""")
def san_resolve(spark, sf):
    # Exact, over-specified, without the capture sign, without check marks, and not a move.
    text = F.expr("""CASE o_custkey % 5 WHEN 0 THEN san WHEN 1 THEN uci WHEN 2 THEN replace(san, 'x', '')
        WHEN 3 THEN regexp_replace(san, '[+#]', '') ELSE 'Ke9' END""")
    return resolve_san(_asked(spark, sf).withColumn("text", text), "text").select("pos_id", "resolved")


@query("san_fallback", f"""WITH {fx.SQL_POSITIONS}, {fx.SQL_MOVES}, {_ASKED} SELECT pos_id, san AS resolved FROM asked""")
def san_fallback(spark, sf):
    text = F.regexp_replace(F.lower("san"), "[+#]", "")
    return resolve_san(_asked(spark, sf).withColumn("text", text), "text", lenient=True).select("pos_id", "resolved")


# Simplified reading of the hand-written SAN, by the rules of the viewer.
_READ = f"""{cs.BASE.replace('WHERE k < 10', 'WHERE k < 10')}, {fx.SQL_MOVES}, {cs.pseudo('v', 'base')},
said AS (SELECT k, j, regexp_replace(coalesce(san, ''), '[+#]+$', '') AS text FROM fx_moves),
viewer_read AS (
  SELECT s.k, s.j, arg_min({cs.sq('frm')}, (7 - frm // 8) * 8 + frm % 8) AS from_name, any_value({cs.sq('dst')}) AS to_name
  FROM said s JOIN v_pm m ON CAST(m.pid AS INT) = s.k AND NOT m.ep AND {cs.sq('dst')} = right(s.text, 2)
    AND m.pc = CASE WHEN regexp_matches(s.text, '^[KQRBN]') THEN left(s.text, 1) ELSE 'P' END
    AND contains(s.text, 'x') = (substr(board, CAST(dst AS INT) + 1, 1) <> '.')
  GROUP BY s.k, s.j)"""


@query("san_to_squares", f"""WITH {_READ} SELECT o.o_orderkey AS pos_id, r.from_name, r.to_name FROM orders o
LEFT JOIN viewer_read r ON r.k = o.o_orderkey % 12 AND r.j = (o.o_orderkey // 12) % 6""")
def san_to_squares(spark, sf):
    return viewer.san_to_squares(_asked(spark, sf), "san").select("pos_id", "from_name", "to_name")


@query("random_baseline", f"""WITH {_PSEUDO}, picks AS (
  SELECT pid, min(md5(concat('7:', pid, ':', {_UCI})) || ':' || {_UCI}) AS pick FROM s_pm GROUP BY pid)
SELECT pid AS pos_id, substr(pick, 34, 2) AS baseline_from, substr(pick, 36, 2) AS baseline_to FROM picks""")
def random_baseline(spark, sf):
    return mv.random_baseline(fx.scatter(spark, sf), "pos_id", "7")


_MODEL_MOVE = f"""{_READ}, base_uci AS (SELECT CAST(pid AS INT) AS k, {_UCI} AS uci FROM v_pm WHERE NOT ep),
model_moves AS (
  SELECT o.o_orderkey AS pos_id, o.o_orderkey % 12 AS k, (o.o_orderkey // 12) % 6 AS j, r.from_name, r.to_name,
    (SELECT min(md5(concat('0:', o.o_orderkey, ':', uci)) || ':' || uci) FROM base_uci u WHERE u.k = o.o_orderkey % 12) AS pick
  FROM orders o LEFT JOIN viewer_read r ON r.k = o.o_orderkey % 12 AND r.j = (o.o_orderkey // 12) % 6),
suggested AS (
  SELECT pos_id, k, j, coalesce(from_name, substr(pick, 34, 2)) AS llm_from, coalesce(to_name, substr(pick, 36, 2)) AS llm_to,
    from_name IS NULL AS is_baseline FROM model_moves)"""


def _suggested(spark, sf):
    return viewer.model_move_or_baseline(_asked(spark, sf), "pos_id", "san")


@query("model_move_or_baseline", f"WITH {_MODEL_MOVE} SELECT pos_id, llm_from, llm_to, is_baseline FROM suggested")
def model_move_or_baseline(spark, sf):
    return _suggested(spark, sf).select("pos_id", "llm_from", "llm_to", "is_baseline")


@query("entry_view", f"""WITH {_MODEL_MOVE}, grouped AS (
  SELECT s.*, f.fen, s.pos_id % 301 AS g, row_number() OVER (PARTITION BY s.pos_id % 301 ORDER BY s.pos_id) AS n
  FROM suggested s JOIN fx_fens f ON f.k = s.k)
SELECT g, pos_id, fen, k < 10 AS valid,
  CASE WHEN k >= 10 THEN 'Invalid FEN in dataset entry.' ELSE concat('It is ', CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END,
    '''s move. Select a piece to play your move.') END AS message,
  CASE WHEN k < 10 THEN llm_from END AS llm_from, CASE WHEN k < 10 THEN llm_to END AS llm_to, CASE WHEN k < 10 THEN is_baseline END AS is_baseline,
  CASE WHEN k < 10 THEN array_to_string(list_reverse(string_split({cs.EXPANDED}, '/')), '') END AS board
FROM grouped WHERE n = 3""")
def entry_view(spark, sf):
    entries = _asked(spark, sf).withColumn("g", F.col("pos_id") % 301)
    return viewer.entry_view(entries, 2, "pos_id", ["g"], "san")


_NAMES = "CASE pos_id % 3 WHEN 0 THEN 'gpt20b' WHEN 1 THEN 'mistral7b' ELSE 'other' END"
_USER_J = "(pos_id // 12 + pos_id % 2) % 6"


@query("compare_moves", f"""WITH {_MODEL_MOVE}, pairs AS (
  SELECT s.pos_id AS id, {_NAMES} AS model, left(m.uci, 2) AS uf, substr(m.uci, 3, 2) AS ut, llm_from, llm_to, pos_id % 5 AS g
  FROM suggested s JOIN fx_moves m ON m.k = s.k AND m.j = {_USER_J})
SELECT model, id, coalesce(uf = llm_from AND ut = llm_to, false) AS is_match,
  CASE WHEN uf = llm_from AND ut = llm_to THEN 'Great! Your move matches the LLM suggestion.' ELSE 'Your move differs from the LLM suggestion.' END AS status,
  concat(uf, ' → ', ut) AS user_text,
  CASE WHEN llm_from IS NULL THEN 'LLM had no suggestion for this position.' ELSE concat('LLM suggested move: ', llm_from, ' → ', llm_to) END AS llm_text,
  CASE WHEN model = 'gpt20b' AND g <> 1 THEN concat('reply ', id) ELSE '' END AS reply_text,
  CASE WHEN g = 0 THEN '✅ LLM predicted move was the best move.' WHEN g = 2 THEN '' ELSE '❌ LLM predicted move was NOT the best move.' END AS verdict
FROM pairs""")
def compare_moves(spark, sf):
    name = F.expr(_NAMES)
    entries = _suggested(spark, sf).select(
        name.alias("model"), F.col("pos_id").alias("id"), "llm_from", "llm_to",
        F.expr("IF(pos_id % 5 = 1, NULL, concat('reply ', pos_id))").alias("full_reply"),
        F.expr("CASE pos_id % 5 WHEN 0 THEN true WHEN 2 THEN NULL ELSE false END").alias("good"))
    user = fx.positions(spark, sf, "ucis").select(
        "pos_id", F.expr("ucis[CAST((pos_id DIV 12 + pos_id % 2) % 6 AS INT)]").alias("uci"))
    user = user.select(name.alias("model"), F.col("pos_id").alias("id"), F.left("uci", F.lit(2)).alias("user_from"),
                       F.substring("uci", 3, 2).alias("user_to"))
    return viewer.compare_moves(user, entries)


def _put(board: str, at: str, what: str) -> str:
    return cs.put(board, at, what)


@query("apply_move", f"""WITH {_PSEUDO} SELECT pid AS pos_id, {_UCI} AS uci,
  {_put(_put('board', 'frm', "'.'"), 'dst', 'substr(board, CAST(frm AS INT) + 1, 1)')} AS after FROM s_pm""")
def apply_move(spark, sf):
    moves = mv.pseudo_legal_moves(fx.scatter(spark, sf).withColumn("board", fenf.board_string(F.col("fen"))))
    frm, to = (fenf.square_index(F.substring("uci", i, 2)) for i in (1, 3))
    return moves.select("pos_id", "uci", fenf.apply_move(F.col("board"), frm, to).alias("after"))
