"""Ranks and pairs against plain Python, and look-ups in sets of legal moves."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plyframe.operators.correlation import rank_correlation
from plyframe.operators.legality import allows, legality_bitmap, position_key, with_legality
from plyframe.operators.moves import legal_moves
from plyframe.operators.reports import saturation_fit
from plyframe.plans import ranks

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def tau(pairs):
    sign = lambda a, b: (a > b) - (a < b)
    signs = [(sign(a, c), sign(b, d)) for i, (a, b) in enumerate(pairs) for c, d in pairs[:i]]
    up, down = sum(s * t > 0 for s, t in signs), sum(s * t < 0 for s, t in signs)
    spread = math.sqrt(sum(s != 0 for s, _ in signs)) * math.sqrt(sum(t != 0 for _, t in signs))
    return len(pairs), up, down, round((up - down) / spread, 9) if spread else None


@pytest.mark.parametrize("bits", [16, 2])
def test_rank_correlation_against_all_pairs(spark, bits):
    rng = random.Random(bits)
    rows = [(g, None if rng.random() < 0.05 else rng.randint(0, 30), rng.choice([0.0, rng.random(), rng.randint(-5, 5) / 1])) for g in ("a", "b", None) for _ in range(90)]
    rows += [("one", 1, 1.0), ("tied", 2, 1.0), ("tied", 2, 3.0), ("none", None, 1.0)]
    got = rank_correlation(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", "g", slice_bits=bits).collect()
    want = {g: tau([(x, y) for h, x, y in rows if h == g and x is not None]) for g in ("a", "b", None, "one", "tied")}
    assert {r.g: (r.n, int(r.concordant), int(r.discordant), r.correlation and round(r.correlation, 9)) for r in got} == want
    empty = spark.createDataFrame([], "x int, y double")
    assert rank_correlation(empty, "x", "y").count() == 0


def test_a_known_curve_is_found_again(spark):
    points = spark.createDataFrame([(s, 1000.0 / s**0.5) for s in (100, 400, 1600, 6400)], "train_size int, d double")
    rows = points.select(F.lit("m").alias("model"), "train_size", F.explode(F.sequence(F.lit(1), F.lit(10000))).alias("i"), "d")
    rows = rows.select("model", "train_size", (F.col("i") <= 8000 - 100 * F.col("d") / 10).alias("good"))
    rows = rows.union(rows.select(F.lit("few"), "train_size", "good").where("train_size < 1000"))
    (fit,) = saturation_fit(rows, [0.25, 0.5, 1.0]).collect()
    assert fit.model == "m" and fit.exponent == 0.5 and abs(fit.ceiling - 80) < 0.01 and abs(fit.slope - 100) < 0.5
    assert abs(fit.saturated_at - (100 / (80 * 0.05)) ** 2) < 10 and abs(fit.residual) < 1


def test_a_rank_reads_its_bucket_only(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") * 7919 % 100_003).alias("k"), F.lit("v").alias("v"))
    folder = str(tmp_path / "index")
    ranks.write_rank_index(rows, folder, "k", ["g"], bucket_rows=200)
    plain = {g: sorted(r.k for r in rows.where(F.col("g") == g).collect()) for g in ("hot", "rare")}
    for index in (0, 199, 499, 500, 4499, 4500):
        found = ranks.entries_at(spark, folder, index, "k", ["g"])
        assert {(r.g, r.k) for r in found.collect()} == {(g, k[index]) for g, k in plain.items() if index < len(k)}
        assert found.columns == rows.columns
    read = set(re.findall("/rows/_bucket(?:=|%3D)([0-9]+)", " ".join(ranks.entries_at(spark, folder, 300, "k", ["g"]).inputFiles())))
    assert 1 <= len(read) <= 2 < len(list((tmp_path / "index" / "rows").glob("_bucket=*")))


def test_sets_of_legal_moves(spark):
    fens = [START, START + " 0 1", START + "  5 9", "8/P6k/8/8/8/8/8/K7 w - -", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1", "8/8/8 w - -", None]
    rows = spark.createDataFrame(list(enumerate(fens)), "id int, fen string")
    assert legality_bitmap(rows).count() == rows.select(position_key(F.col("fen")).alias("k")).where("k IS NOT NULL").distinct().count() <= 4
    held = with_legality(rows)
    counts = {r.id: r.n for r in held.select("id", F.aggregate("bits", F.lit(0), lambda a, b: a + F.bit_count(b)).alias("n")).collect()}
    pairs = {r.id: r.n for r in legal_moves(rows).groupBy("id").agg(F.count_distinct(F.left("uci", F.lit(4))).alias("n")).collect()}
    assert {i: n or 0 for i, n in counts.items()} == {i: pairs.get(i, 0) for i in range(len(fens))} and counts[0] == 20 and counts[3] == 4
    asked = held.where("id IN (0, 3, 5)").withColumn("uci", F.explode(F.array(*map(F.lit, ["e2e4", "e2e5", "a7a8q", "zz", "", "h1h9"]))))
    assert {(r.id, r.uci) for r in asked.where(allows(F.col("bits"), F.col("uci"))).collect()} == {(0, "e2e4"), (3, "a7a8q")}
