"""Move rules against published counts and an independent SQL generator."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plyframe.operators.moves import legal_moves
from plyframe.operators.position import with_position
from plyframe.operators.replies import resolve_san
from plyframe.operators.san import with_san, with_uci_move
from plyframe.queries import chess_sql as cs
from plyframe.queries.fixtures import FENS

DEPTH_1 = {0: 20, 1: 48, 2: 14, 3: 6, 4: 44, 5: 46, 6: 31}
DEPTH_2 = {0: 400, 1: 2039, 2: 191, 3: 264, 4: 1486, 5: 2079}  # published node counts


def _children():
    """(k, fen) after every legal move, made by the SQL generator."""
    rows = duckdb.sql(f"WITH {cs.LEGAL} SELECT CAST(pid AS INT), white, after, next_ep FROM a_legal").fetchall()
    out = []
    for k, white, board, ep in rows:
        ranks = [board[8 * r:8 * r + 8] for r in range(7, -1, -1)]
        for n in range(8, 0, -1):
            ranks = [r.replace("." * n, str(n)) for r in ranks]
        rights = FENS[k].split()[2]
        ep_name = "-" if ep < 0 else "abcdefgh"[ep % 8] + str(ep // 8 + 1)
        out.append((k, f"{'/'.join(ranks)} {'b' if white else 'w'} {rights} {ep_name}"))
    return out


@pytest.fixture(scope="module")
def children(spark):
    rows = [(i, k, fen) for i, (k, fen) in enumerate(_children())]
    return spark.createDataFrame(rows, "id int, k int, fen string").repartition(8).cache()


@pytest.fixture(scope="module")
def grandmoves(children):
    return with_san(legal_moves(children, keep_position=True)).select("id", "k", "fen", "uci", "san").cache()


def test_published_counts_at_depth_one(spark):
    df = spark.createDataFrame(list(enumerate(FENS)), "k int, fen string")
    counts = {r.k: r["count"] for r in legal_moves(df).groupBy("k").count().collect()}
    assert {k: counts.get(k) for k in DEPTH_1} == DEPTH_1
    assert not {7, 8, 10, 11} & set(counts)


def test_published_counts_at_depth_two(grandmoves):
    counts = {r.k: r["count"] for r in grandmoves.groupBy("k").count().collect()}
    assert {k: counts[k] for k in DEPTH_2} == DEPTH_2


def test_san_names_one_move_and_reads_back(grandmoves):
    per = grandmoves.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("san").alias("d"))
    assert per.where("n <> d").count() == 0
    back = resolve_san(grandmoves, "san", out="again")
    assert back.where("again IS NULL OR again <> san").count() == 0
    stripped = grandmoves.withColumn("low", F.regexp_replace(F.lower("san"), "[+#]", ""))
    again = resolve_san(stripped, "low", lenient=True, out="again")
    # Lower case is ambiguous only between a b-pawn and a bishop; the pawn is read first.
    assert again.where("again IS NULL OR (again <> san AND NOT san LIKE 'B%')").count() == 0


def test_mate_and_check_marks(spark):
    fens = [
        ("6k1/5ppp/8/8/8/8/8/R3K3 w Q -", "a1a8", "Ra8#"), ("6k1/5pp1/8/8/8/8/8/R3K3 w Q -", "a1a8", "Ra8+"),
        ("rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq g3", "d8h4", "Qh4#"),
        ("8/8/8/3k4/8/8/4P3/4K3 w - -", "e2e4", "e4+"), ("4k3/8/8/8/8/8/8/4K2R w K -", "e1h1", "O-O"),
        ("7k/5Q2/6K1/8/8/8/8/8 w - -", "f7g7", "Qg7#"), ("k7/8/8/8/8/8/8/K6R b - -", "a8a7", "Ka7"),
        # Mate by a double step, unless a pawn can take it en passant.
        ("8/2Q5/8/3k4/3p4/6NB/4P3/K7 w - -", "e2e4", "e4+"), ("8/2Q5/8/3k4/3n4/6NB/4P3/K7 w - -", "e2e4", "e4#"),
    ]
    df = spark.createDataFrame(fens, "fen string, u string, expected string")
    rows = with_san(with_uci_move(with_position(df), "u")).select("expected", "san").collect()
    assert [r.san for r in rows] == [r.expected for r in rows]


def test_en_passant_that_uncovers_the_king_is_illegal(spark):
    df = spark.createDataFrame([("8/8/8/K2pP2r/8/8/8/7k w - d6",), ("8/8/8/3pP2r/8/8/K7/7k w - d6",)], "fen string")
    moves = legal_moves(df).where("uci = 'e5d6'").select("fen").collect()
    assert [r.fen for r in moves] == ["8/8/8/3pP2r/8/8/K7/7k w - d6"]


def test_generation_needs_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame(list(enumerate(FENS)), "k int, fen string")
    plan = legal_moves(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "CartesianProduct" not in plan
