"""A stream of replies gives the rows of the batch."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plyframe.functions.text import stop_index
from plyframe.operators.position import never_null
from plyframe.operators.scoring import evaluate_replies, positioned_samples
from plyframe.queries import scores
from plyframe.queries.fixtures import replies as fixture_replies
from plyframe.streaming.replies import REPLY_SCHEMA, read_replies, score_stream
from plyframe.streaming.state import PARTITIONS, partitions_of, state_in_files
from plyframe.streaming.stops import PIECE_SCHEMA, packed, read_pieces, stop_stream, unpacked

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def test_stream_equals_batch(spark, tmp_path):
    samples = spark.createDataFrame([(1, START, ["e4", "d4"]), (2, START, ["Nf3"])], "id long, fen string, top_moves array<string>")
    said = [("m", 1, "Best Move: e4"), ("m", 2, "Best Move: e5"), ("n", 1, "best move: Nf3 ok"), ("n", 2, None), ("n", 3, "Best Move: e4")]
    replies = spark.createDataFrame(said, REPLY_SCHEMA)
    for part in (replies.where("model = 'm'"), replies.where("model = 'n'")):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    scored = score_stream(read_replies(spark, str(tmp_path / "in")), samples)
    run = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.model, r.id)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(evaluate_replies(samples, replies).collect(), key=key)


def test_stops_of_pieces_in_any_order(spark, tmp_path):
    texts = {1: "My plan. Best Move: e4 and d4", 2: "none at all", 3: "Nf3 best", 4: "a Best Move: Qxd8+ then", 5: "Best Move: x" + " z" * 30 + " O-O-O now"}
    pieces = [("m", i, n, p, n == len(t) // 3) for i, t in texts.items() for n, p in enumerate(t[k : k + 3] for k in range(0, len(t) + 3 - len(t) % 3, 3))]
    silent = [("m", 9, 0, "Best ", False), ("m", 9, 2, "e4", False)]
    random.Random(1).shuffle(pieces)
    for part in range(3):
        rows = spark.createDataFrame(pieces[part::3] + (pieces[:4] if part == 2 else []) + silent[part:part + 1], PIECE_SCHEMA)
        rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    arrays = spark.createDataFrame([(i, [t[k : k + 3] for k in range(0, len(t) + 3 - len(t) % 3, 3)]) for i, t in texts.items()], "id long, p array<string>")
    for marker in (True, False):
        want = {r.id: r.stop for r in arrays.select("id", stop_index(F.col("p"), marker).alias("stop")).collect()}
        out = str(tmp_path / f"out{marker}")
        run = stop_stream(read_pieces(spark, str(tmp_path / "in"), 1), marker, silence=None).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", out + "-state").trigger(availableNow=True).start()
        run.awaitTermination(120)
        rows = spark.read.parquet(out).collect()
        assert {r.id: r.stop for r in rows} == want and len(rows) == len(want)
        assert {r.ended for r in rows if r.stop is None} <= {"last"}


def test_a_silent_reply_ends(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1, 0, "Best Move: ", False), ("m", 2, 0, "Best Move: e4", False)], PIECE_SCHEMA)
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run = stop_stream(read_pieces(spark, str(tmp_path / "in")), True, silence="2 seconds").writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", out + "-state").start()
    for _ in range(60):
        run.awaitTermination(1)
        found = {(r.id, r.stop, r.ended) for r in spark.read.schema("model string, id long, stop int, ended string").parquet(out).collect()} if os.path.isdir(out) else set()
        if len(found) == 2:
            break
    run.stop()
    assert found == {(1, None, "silence"), (2, 1, "move")}


def test_replies_share_calls(spark, tmp_path):
    """Four states hold all replies; ids beyond the whole numbers of doubles and null ones stay apart."""
    ids = [None, *(2**60 + k for k in range(400))]
    for part in range(2):
        rows = [("m", i, n, p, n == 2) for i in ids for n, p in enumerate(("Best Move:", " e4", " ok")) if (n + (i or 0)) % 2 == part]
        spark.createDataFrame(rows, PIECE_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stops, out = stop_stream(read_pieces(spark, str(tmp_path / "in"), 1), True, silence=None, buckets=4), str(tmp_path / "out")
    run = stops.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(((r.id, r.stop, r.ended) for r in spark.read.parquet(out).collect()), key=str) == sorted(((i, 2, "move") for i in ids), key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 4


def test_states_of_a_bucket_are_kept_small():
    decided = {("org/model-a:1", str(4096 * k)): 0 for k in range(10_000)} | {(None, None): 5}
    waiting = {("m", "7"): (9, "Best ", False, True, 2, [(4, " e4\x00\u00e9", True)]), ("m", None): (0, "", True, False, 0, [])}
    state = packed(decided, waiting)
    assert len(state) < 10 * len(decided)
    ends, others = unpacked(state)
    assert ends == decided and {k: (*v[:5], [tuple(w) for w in v[5]]) for k, v in others.items()} == waiting
    assert unpacked(packed({}, {})) == ({}, {})


@pytest.mark.parametrize("name", ["stop_rule_stream", "stop_rule_san_stream", "rates_of_stream"])
def test_executors_hold_no_state_between_batches(spark, tmp_path, monkeypatch, name):
    """Their memory was that of several versions of all replies so far."""
    spark.range(1, 1201).selectExpr("id AS o_orderkey", "id % 90 AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    runs, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: runs.append(start(self, *a, **k)) or runs[-1])
    before = spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory")
    got = getattr(scores, name)(spark, str(tmp_path))
    states = [s for p in runs[0].recentProgress for s in p["stateOperators"]]
    assert len(states) >= 3 and max(s["memoryUsedBytes"] / s["numShufflePartitions"] for s in states) < 1000
    assert len(runs[0].recentProgress) == 3 and spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == before
    if name == "rates_of_stream":
        key = lambda r: r.model
        assert sorted(got.collect(), key=key) == sorted(scores.move_rates(spark, str(tmp_path)).collect(), key=key)
    else:
        said = fixture_replies(spark, str(tmp_path)).where("full_reply <> ''").count()
        want = scores.stop_rule_marker if name == "stop_rule_stream" else scores.stop_rule_san
        assert got.count() == said and not got.exceptAll(want(spark, str(tmp_path))).count()


def test_states_are_dealt_by_the_size_of_the_files(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"{k}.json", "wb") as f:
            f.truncate(50 << 20)
    had = spark.conf.get(PARTITIONS)
    assert partitions_of(spark, str(tmp_path)) == 3
    with state_in_files(spark, 211):
        assert spark.conf.get(PARTITIONS) == "211"
    with state_in_files(spark, 2):
        assert spark.conf.get(PARTITIONS) == had
    assert spark.conf.get(PARTITIONS) == had


def test_positions_read_once_give_the_same_scores(spark, tmp_path):
    samples = spark.createDataFrame([(1, START, ["e4", "d4"]), (2, "9" + START, ["e4"]), (3, None, ["e4"])], "id long, fen string, top_moves array<string>")
    said = spark.createDataFrame([("m", i, f"Best Move: {move}") for i in (1, 2, 3) for move in ("e4", "Ke2", "Nf3")], REPLY_SCHEMA)
    want = evaluate_replies(samples, said).collect()
    positions = positioned_samples(samples)
    positions.write.parquet(str(tmp_path / "positions"))
    read = spark.read.parquet(str(tmp_path / "positions"))
    assert len(want) == 3 and sorted(evaluate_replies(read, said, positioned=True).collect()) == sorted(want)
    assert [f.nullable for f in never_null(read).schema] == [f.nullable for f in positions.schema]
