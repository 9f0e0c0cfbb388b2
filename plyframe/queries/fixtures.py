"""Positions, documents, replies and results derived row by row from the driver tables.

Each exists twice: as a DataFrame for the queries and as SQL for the oracles. The small literal
tables (12 positions, 6 candidate moves each, SAN written by hand) are joined to every order or
line item, so all inputs grow with the tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -",
    "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -",
    "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -",
    "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1",
    "rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8",
    "r4rk1/1pp1qppp/p1np1n2/2b1p1B1/2B1P1b1/P1NP1N2/1PP1QPPP/R4RK1 w - - 0 10",
    "rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w KQkq f6",
    "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3",
    "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1",
    "rnbqk1nr/1p2ppbp/p2p2p1/8/3PP3/2N2N1P/PP3PP1/R1BQKB1R b KQkq -",
    "8/8/8/8/8/8/8 w - -",
    "rnbqkbnr/pppppppp/9/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -",
]

# Candidate moves with the SAN a legal one has; None is illegal or not a move.
MOVES: dict[int, list[tuple[str, str | None]]] = {
    0: [("e2e4", "e4"), ("g1f3", "Nf3"), ("e2e5", None), ("d2d4", "d4"), ("zzzz", None), ("b1c3", "Nc3")],
    1: [("e1g1", "O-O"), ("e1c1", "O-O-O"), ("e5f7", "Nxf7"), ("d5e6", "dxe6"), ("f3f6", "Qxf6"), ("e1e3", None)],
    2: [("b4f4", "Rxf4+"), ("b4b1", "Rb1"), ("g2g3", "g3+"), ("b5b6", None), ("e2e4", "e4"), ("a5a6", "Ka6")],
    3: [("g1h1", "Kh1"), ("c4c5", "c5"), ("d2d4", "d4"), ("f1f2", "Rf2"), ("f3d4", "Nd4"), ("b4c5", "Bc5")],
    4: [("d7c8q", "dxc8=Q"), ("d7c8n", "dxc8=N"), ("e1g1", "O-O"), ("e1f2", "Kxf2"), ("d7d8q", None), ("e1c1", None)],
    5: [("g5f6", "Bxf6"), ("c4f7", "Bxf7+"), ("c3d5", "Nd5"), ("a1d1", "Rad1"), ("f1d1", "Rfd1"), ("g1g2", None)],
    6: [("e5f6", "exf6"), ("e5d6", None), ("d1h5", "Qh5+"), ("d2d4", "d4"), ("e1e2", "Ke2"), ("f1b5", "Bb5+")],
    7: [("a2a3", None)] * 6,
    8: [("h8g8", None)] * 6,
    9: [("b8c6", "Nc6"), ("b7b5", "b5"), ("g7d4", "Bxd4"), ("e8g8", None), ("d6d5", "d5"), ("c8h3", "Bxh3")],
    10: [("a2a3", None)] * 6,
    11: [("a2a3", None)] * 6,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_positions(spark: SparkSession) -> DataFrame:
    """The twelve positions with their moves as arrays; broadcast wherever it is joined."""
    return spark.createDataFrame(pa.table({
        "k": pa.array(range(12), pa.int64()), "fen": FENS,
        "ucis": [[u for u, _ in MOVES[k]] for k in range(12)],
        "sans": pa.array([[s for _, s in MOVES[k]] for k in range(12)], pa.list_(pa.string())),
    }))


def positions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """pos_id, k, fen: one position per order, dealt to all cores: the table is one small file, but each of its rows
    stands for much work."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos_id"), (F.col("o_orderkey") % 12).alias("k"), "o_custkey")
    orders = orders.repartition(spark.sparkContext.defaultParallelism)
    return orders.join(F.broadcast(literal_positions(spark)), "k").select("pos_id", "k", "fen", *more)


_PV = """named_struct(
    'cp', CAST((o_custkey * 31 + i * 17 + j * 13) % 600 - 300 AS INT),
    'mate', IF((pos_id + i + j) % 53 = 0, CAST(pos_id % 7 - 3 AS INT), NULL),
    'line', CASE WHEN (pos_id + 3 * i + 5 * j) % 97 = 0 THEN '   '
                 WHEN (pos_id + i + 7 * j) % 89 = 0 THEN NULL
                 WHEN (pos_id + 5 * i + j) % 83 = 0 THEN ''
                 ELSE concat(ucis[CAST((pos_id DIV 12 + 2 * i + j + o_custkey) % 6 AS INT)], ' e7e5 d7d5') END)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_id, k, fen, evals: nested as in the corpus, with null, empty and blank lines."""
    pvs = f"""transform(filter(sequence(0L, 3L), j -> j < (o_custkey DIV 4 + i) % 4), j -> {_PV})"""
    evals = f"""IF(o_custkey % 50 = 49, NULL, transform(filter(sequence(0L, 2L), i -> i < o_custkey % 4),
        i -> named_struct('knodes', pos_id * 10 + i, 'depth', CAST(20 + i AS INT), 'pvs', {pvs})))"""
    return positions(spark, sf_dir, "ucis", "o_custkey").select("pos_id", "k", "fen", F.expr(evals).alias("evals"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, id, k, fen, full_reply: two models, eight shapes of reply."""
    rows = positions(spark, sf_dir, "ucis", "sans").select(
        F.col("pos_id").alias("id"), "k", "fen",
        F.expr("ucis[CAST((pos_id DIV 12) % 6 AS INT)]").alias("uci"),
        F.expr("sans[CAST((pos_id DIV 12) % 6 AS INT)]").alias("san"),
        F.expr("inline(array(named_struct('m', 0, 'model', 'org/model-a:1'), named_struct('m', 1, 'model', 'org/model-b')))"),
    )
    text = r"""CASE (id + m) % 8
        WHEN 0 THEN concat('My reasoning: Strong tactical position.', char(10), 'Best Move: ', coalesce(san, 'Ke9'))
        WHEN 1 THEN coalesce(san, 'none')
        WHEN 2 THEN concat('best move: a1', char(10), 'BEST MOVE:', char(10), '  ', coalesce(san, ''), ' ok')
        WHEN 3 THEN concat('Best Move: ', uci)
        WHEN 4 THEN 'I am not sure.'
        WHEN 5 THEN concat('Best Move: ', lower(coalesce(san, 'x')))
        WHEN 6 THEN 'Best Move: Qh9 or h7#'
        ELSE concat('<choose>the best move for White is ', coalesce(san, '?'), '</choose> Best Move: ',
                    coalesce(san, '?')) END"""
    return rows.select("model", "id", "k", "fen", F.expr(text).alias("full_reply"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, model, legal, good as text with noisy booleans."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'gpt20b' WHEN 1 THEN 'mistral7b' ELSE 'other' END").alias("model"),
        F.expr("""CASE WHEN quality = 1 THEN CASE doc_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'true'
                  ELSE 'True' END ELSE CASE doc_id % 2 WHEN 0 THEN 'False' ELSE ' FALSE' END END""").alias("legal"),
        F.expr("CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END").alias("good"),
    )


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_id, fen: pieces strewn over the board by the line items of an order. A board has 64
    squares at most, since the line items are reduced per square first."""
    pieces = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pos_id"), (F.col("l_partkey") % 64).cast("int").alias("sq"),
        F.expr("substr('PNBRQKpnbrqk', CAST(1 + l_suppkey % 12 AS INT), 1)").alias("piece"),
    ).groupBy("pos_id", "sq").agg(F.max("piece").alias("piece"))
    # Four numbers of 16 squares, a hexadecimal digit for each: sums of fixed size, where lists would be sorted by board.
    code = "coalesce(instr('PNBRQKpnbrqk', piece), 0)"
    # A piece without a square fails, as it would be lost.
    pieces = pieces.withColumn("sq", F.expr("coalesce(sq, CAST(raise_error('a line item without a square') AS INT))"))
    boards = pieces.groupBy("pos_id").agg(*(
        F.expr(f"bit_or(IF(sq BETWEEN {16 * q} AND {16 * q + 15}, shiftleft(CAST({code} AS BIGINT), sq % 16 * 4), 0L))").alias(f"q{q}") for q in range(4)))
    ranks = ", ".join(
        f"translate(reverse(substr(lpad(hex(q{r // 2}), 16, '0'), {9 - r % 2 * 8}, 8)), '0123456789ABC', '1PNBRQKpnbrqk')" for r in range(7, -1, -1)
    )
    return boards.select("pos_id", F.expr(f"concat(concat_ws('/', {ranks}), IF(pos_id % 2 = 0, ' w', ' b'))").alias("fen"))


# --- the same as SQL ------------------------------------------------------------------------

def _q(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


SQL_FENS = "fx_fens(k, fen) AS (VALUES " + ", ".join(f"({k}, '{f}')" for k, f in enumerate(FENS)) + ")"
SQL_MOVES = "fx_moves(k, j, uci, san) AS (VALUES " + ", ".join(
    f"({k}, {j}, '{u}', {_q(s)})" for k, ms in MOVES.items() for j, (u, s) in enumerate(ms)) + ")"
SQL_POSITIONS = SQL_FENS + """,
fx_positions AS (SELECT o.o_orderkey AS pos_id, f.k, f.fen, o.o_custkey FROM orders o JOIN fx_fens f ON f.k = o.o_orderkey % 12)"""
# One row per engine line; rows of a rejected document included.
SQL_PVS = SQL_POSITIONS + ", " + SQL_MOVES + """,
fx_pvs AS (
  SELECT p.pos_id, p.k, p.fen, i AS eval_idx, v.j AS pv_idx,
    CAST((o_custkey * 31 + i * 17 + v.j * 13) % 600 - 300 AS INT) AS cp,
    CASE WHEN (pos_id + i + v.j) % 53 = 0 THEN CAST(pos_id % 7 - 3 AS INT) END AS mate,
    CASE WHEN (pos_id + 3 * i + 5 * v.j) % 97 = 0 THEN '   ' WHEN (pos_id + i + 7 * v.j) % 89 = 0 THEN NULL
         WHEN (pos_id + 5 * i + v.j) % 83 = 0 THEN '' ELSE concat(m.uci, ' e7e5 d7d5') END AS line,
    m.uci, m.san
  FROM fx_positions p CROSS JOIN generate_series(0, 2) AS e(i) CROSS JOIN generate_series(0, 3) AS v(j)
  JOIN fx_moves m ON m.k = p.k AND m.j = (pos_id // 12 + 2 * i + v.j + o_custkey) % 6
  WHERE o_custkey % 50 <> 49 AND i < o_custkey % 4 AND v.j < (o_custkey // 4 + i) % 4)"""
# Legal first moves of accepted documents, first occurrence per SAN, numbered in document order.
SQL_TOP = SQL_PVS + """,
fx_first AS (
  SELECT pos_id, fen, k, san, min(eval_idx * 4 + pv_idx) AS seen FROM fx_pvs
  WHERE san IS NOT NULL AND line LIKE '% e7e5%'
    AND pos_id NOT IN (SELECT pos_id FROM fx_pvs WHERE line = '   ')
  GROUP BY pos_id, fen, k, san),
fx_top AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY seen) AS rk FROM fx_first),
fx_samples AS (
  SELECT pos_id, k, fen, max(CASE WHEN rk = 1 THEN san END) AS best_move,
    string_agg(san, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_moves
  FROM fx_top GROUP BY pos_id, k, fen)"""
SQL_REPLIES_BODY = """,
fx_replies AS (
  SELECT d.model, p.pos_id AS id, p.k, p.fen, (p.pos_id + d.m) % 8 AS shape, m.uci, m.san,
    CASE (p.pos_id + d.m) % 8
      WHEN 0 THEN concat('My reasoning: Strong tactical position.', chr(10), 'Best Move: ', coalesce(m.san, 'Ke9'))
      WHEN 1 THEN coalesce(m.san, 'none')
      WHEN 2 THEN concat('best move: a1', chr(10), 'BEST MOVE:', chr(10), '  ', coalesce(m.san, ''), ' ok')
      WHEN 3 THEN concat('Best Move: ', m.uci)
      WHEN 4 THEN 'I am not sure.'
      WHEN 5 THEN concat('Best Move: ', lower(coalesce(m.san, 'x')))
      WHEN 6 THEN 'Best Move: Qh9 or h7#'
      ELSE concat('<choose>the best move for White is ', coalesce(m.san, '?'), '</choose> Best Move: ', coalesce(m.san, '?')) END AS full_reply
  FROM fx_positions p CROSS JOIN (VALUES (0, 'org/model-a:1'), (1, 'org/model-b')) AS d(m, model)
  JOIN fx_moves m ON m.k = p.k AND m.j = (p.pos_id // 12) % 6),
fx_parsed AS (
  SELECT *,
    CASE WHEN san IS NULL THEN '' WHEN shape IN (0, 2, 7) THEN san
         WHEN shape = 3 AND length(uci) = 4 THEN san
         WHEN shape = 5 AND regexp_matches(san, '^[a-hB]') AND san NOT LIKE '%=%' THEN san ELSE '' END AS model_move,
    CASE WHEN san IS NULL THEN '' WHEN shape IN (0, 1, 7) THEN san
         WHEN shape = 3 AND length(uci) = 4 THEN san
         WHEN shape = 5 AND regexp_matches(san, '^[a-hB]') AND san NOT LIKE '%=%' THEN san ELSE '' END AS any_move
  FROM fx_replies)"""
SQL_REPLIES = SQL_POSITIONS + ", " + SQL_MOVES + SQL_REPLIES_BODY
SQL_SCORED = SQL_TOP + SQL_REPLIES_BODY + """,
fx_scored AS (
  SELECT r.model, r.id, r.k, r.fen, r.model_move, r.full_reply, r.model_move <> '' AS legal,
    list_contains(string_split(s.top_moves, ','), r.model_move) AS good, s.top_moves
  FROM fx_parsed r JOIN fx_samples s ON s.pos_id = r.id)"""
SQL_RESULTS = """fx_results AS (
  SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'gpt20b' WHEN 1 THEN 'mistral7b' ELSE 'other' END AS model,
    CASE WHEN quality = 1 THEN CASE doc_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'true' ELSE 'True' END
         ELSE CASE doc_id % 2 WHEN 0 THEN 'False' ELSE ' FALSE' END END AS legal,
    CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END AS good
  FROM labels)"""
SQL_SCATTER = """fx_scatter AS (
  SELECT l_orderkey AS pos_id, l_partkey % 64 AS sq, max(substr('PNBRQKpnbrqk', CAST(1 + l_suppkey % 12 AS INT), 1)) AS piece
  FROM lineitem GROUP BY l_orderkey, l_partkey % 64),
fx_boards AS (
  SELECT pos_id, pos_id % 2 = 0 AS white, string_agg(coalesce(piece, '.'), '' ORDER BY sq) AS board
  FROM (SELECT p.pos_id, g.sq, s.piece FROM (SELECT DISTINCT pos_id FROM fx_scatter) p CROSS JOIN generate_series(0, 63) AS g(sq)
        LEFT JOIN fx_scatter s ON s.pos_id = p.pos_id AND s.sq = g.sq)
  GROUP BY pos_id)"""
