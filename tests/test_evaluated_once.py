"""Costly columns are worked out once a row: the optimizer must not copy them into filters and lambdas."""

import pytest
from pyspark.sql import functions as F

from plyframe.functions import fen as fenf
from plyframe.operators import samples, viewer
from plyframe.operators.moves import legal_moves
from plyframe.operators.position import with_position
from plyframe.operators.prompts import legal_san_list
from plyframe.operators.replies import reply_to_san
from plyframe.operators.san import with_san
from plyframe.queries import scores
from plyframe.queries.chess import _kings
from plyframe.queries.fixtures import scatter
from plyframe.queries.prompts import chat_messages
from plyframe.sources.results import write_evaluations

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_check_of_a_fen_in_a_lambda(spark):
    rows = with_position(spark.createDataFrame([(START,)], "fen string"), strict=True).select("occ")
    assert not [line for line in optimized(rows).splitlines() if "lambdafunction" in line and "RLIKE" in line]
    assert rows.first().occ == 0xFFFF00000000FFFF - (1 << 64)


def test_lines_are_made_once(spark):
    rows = spark.createDataFrame([(1, START, ["e2e4 e7e5", "zzzz"]), (2, START, ["   "]), (3, START, [])], "id long, fen string, said array<string>")
    evals = F.expr("array(named_struct('knodes', 1L, 'depth', 1, 'pvs', transform(said, x -> named_struct('cp', 0, 'mate', 0, 'line', replace(x, 'marker77', '')))))")
    docs = rows.select("id", "fen", evals.alias("evals"))
    plan = optimized(samples.valid_samples(docs, "id"))
    assert plan.count("marker77") == 1
    assert [(r.id, r.best_move) for r in samples.valid_samples(docs, "id").collect()] == [(1, "e4")]


def test_the_chosen_square_is_found_once_a_position(spark):
    rows = spark.createDataFrame([(1, START)], "id long, fen string")
    square = fenf.square_name(F.regexp_instr(fenf.board_string(F.col("fen")), F.lit("N")) - 1)
    moves = viewer.piece_destinations(rows, "id", square)
    assert not [line for line in optimized(moves).splitlines() if "Join" in line and "regexp_instr" in line]
    assert sorted(r.to_name for r in moves.collect()) == ["a3", "c3"]


def test_replies_to_check_are_sought_in_compiled_columns(spark):
    rows = spark.createDataFrame([(1, "7k/5Q2/6K1/8/8/8/8/8 w - -")], "id long, fen string")
    moves = with_san(legal_moves(rows, keep_position=True)).select("uci", "san")
    assert "named_struct(s_n" not in optimized(moves)
    assert {"Qg7#", "Qe8#", "Qf6+"} <= {r.san for r in moves.collect()}


def test_strewn_boards_are_put_together_once(spark):
    plan = optimized(_kings(spark, "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "lambdafunction" in line and "overlay" in line]
    assert "collect_list" not in plan


def test_empty_squares_are_left_out_by_code(spark):
    plan = optimized(legal_moves(spark.createDataFrame([(START,)], "fen string")))
    assert not [line for line in plan.splitlines() if "Filter" in line and "upper(" in line]


def test_strewn_boards(spark, tmp_path):
    rows = [(2, 0, 0), (2, 64, 7), (2, 63, 11), (3, 5, None), (4, 70, None), (5, -3, 2), (None, 9, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.pos_id: r.fen.replace("11111111", "8") for r in scatter(spark, str(tmp_path)).collect()}
    assert got == {2: "1111111k/8/8/8/8/8/8/n1111111 w", 3: "/".join(["8"] * 8) + " b", 4: "/".join(["8"] * 8) + " w",
                   5: "/".join(["8"] * 8) + " b", None: "8/8/8/8/8/8/1R111111/8" + " b"}
    spark.createDataFrame([(2, None, 1)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    with pytest.raises(Exception, match="without a square"):
        scatter(spark, f"{tmp_path}/none").collect()


def test_a_board_is_drawn_outside_of_explode(spark):
    plan = optimized(chat_messages(spark, "/root/testdata/sf0.001"))
    assert "regexp_replace" in plan and "regexp_replace" not in plan.split("Generate explode(")[1].split("false, [")[0]


def test_scores_are_made_once_for_files_and_summaries(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(move):
        made.add(1)
        return move

    rows = spark.range(20).selectExpr("'m' AS model", "id", f"'{START}' AS fen", "'e4' AS move", "'e4' AS full_reply", "true AS legal", "true AS good", "array('e4') AS top_moves")
    scored = rows.withColumn("model_move", F.udf(counted, "string")("move")).drop("move")
    write_evaluations(scored, rows.select("model").distinct(), str(tmp_path / "r"))
    assert made.value == 20


def test_a_stream_of_replies_comes_in_files_of_many_tasks(spark, tmp_path, monkeypatch):
    folders = iter(["source", "out", "state"])
    monkeypatch.setattr(scores, "scratch_folder", lambda _: str(tmp_path / next(folders)))
    assert {r.test_samples for r in scores.rates_of_stream(spark, "/root/testdata/sf0.001").collect()} != set()
    assert len(list((tmp_path / "source").glob("*.json"))) == 3 * spark.sparkContext.defaultParallelism


def test_moves_carry_the_number_of_their_row(spark):
    rows = spark.createDataFrame([(1, "k7/8/8/8/8/8/8/K7 w - -", "x"), (2, "k7/8/8/8/8/8/8/K7 w - -", None), (3, "8/8/8/8/8/8/8/8 w - -", "y")],
                                 "id long, fen string, said77 string")
    lists = legal_san_list(rows)
    assert not [line for line in optimized(lists).splitlines() if "Aggregate" in line and "said77" in line]
    assert sorted((r.id, r.said77, r.legal_san) for r in lists.collect()) == [(1, "x", "Ka2, Kb1, Kb2"), (2, None, "Ka2, Kb1, Kb2")]


def test_a_reply_without_a_move_needs_no_board(spark):
    rows = spark.createDataFrame([(1, START, "Best Move: e4"), (2, START, "I am not sure."), (3, START, None), (4, None, "Best Move: e4")],
                                 "id long, fen string, full_reply string")
    moves = reply_to_san(rows)
    assert "CASE WHEN NOT (_candidate" in optimized(moves)
    assert [(r.id, r.fen, r.model_move) for r in moves.orderBy("id").collect()] == [(1, START, "e4"), (2, START, ""), (3, START, ""), (4, None, "")]
