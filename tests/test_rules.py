"""Quirks of samples, texts, files and numbering."""

import io
import json

import zstandard
from pyspark.sql import functions as F

from plyframe.functions import fen as fenf
from plyframe.functions import text as t
from plyframe.operators import samples, splits, tokens
from plyframe.operators.moves import legal_moves
from plyframe.operators.prompts import legal_san_list
from plyframe.operators.replies import reply_to_san
from plyframe.operators.scoring import score_moves
from plyframe.plans import ordinals
from plyframe.plans.scratch import written
from plyframe.sources import evals, results
from plyframe.sources.results import read_results, write_results
from plyframe.sources.zstd_lines import read_zstd_lines

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def _doc(key, fen, *lines):
    return (key, fen, None if lines == (None,) else [(1, 1, [(0, None, x) for x in lines])])


def test_samples(spark):
    docs = spark.createDataFrame([
        _doc(1, START, "e2e4 e7e5", "   "), _doc(2, START, None), _doc(3, START, "e2e4 x", "d2d4", "e2e4"),
        _doc(4, START, "a2a3", "b2b3", "c2c3", "d2d3", "e2e3", "f2f3", "g2g3"), _doc(5, START, "e2e5", "zz", None, "", "g1f3"),
        _doc(6, "", "e2e4"), _doc(7, START, "e7e5"), _doc(8, "8/8 w", "e2e4"),
    ], f"id int, {samples.EVAL_SCHEMA}")
    rows = {r.id: (r.best_move, r.top_moves) for r in samples.valid_samples(docs, "id").collect()}
    assert rows == {3: ("e4", ["e4", "d4"]), 4: ("a3", ["a3", "b3", "c3", "d3", "e3"]), 5: ("Nf3", ["Nf3"])}
    split = splits.sequential_split(splits.take_first_valid(docs, 6, "id"), 2, 2, 2, "id")
    assert {r.split: r.n for r in splits.split_counts(split).collect()} == {"train": 2, "val": 1, "test": 0}


def test_candidates(spark):
    cases = [
        ("Best Move: Nf3+ ok", "Nf3"), ("best move: éNf3 d4", "d4"), ("best move: a1\nBEST MOVE:\n Nf3", "Nf3"),
        ("Nf3", ""), ("Best Move: e4é", ""), ("best move: bxc3", "bxc3"), ("Best move: O-O-O!", "O-O-O"), ("Best Move: e8=Q#", "e8=Q"),
    ]
    df = spark.createDataFrame(cases, "reply string, expected string").withColumn("got", t.candidate(F.col("reply")))
    assert [(r.reply, r.got) for r in df.collect()] == cases


def test_fen_rules(spark):
    cases = [(START, True, True), ("8/8/8/8/8/8/8 w - -", False, False), ("44/8/8/8/8/8/8/8 w - -", True, False),
             ("8/8/8/8/8/8/8/8", False, True), ("8/8/8/8/8/8/8/9 w", False, False), ("8/8/8/8/8/8/8/8 b KQ e9", True, False)]
    df = spark.createDataFrame(cases, "f string, v boolean, s boolean")
    rows = df.select("v", "s", fenf.fen_valid_viewer(F.col("f")).alias("gv"), fenf.fen_valid_strict(F.col("f")).alias("gs"))
    assert all(r.v == r.gv and r.s == r.gs for r in rows.collect())


def test_ordinals_across_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("key"), (F.col("id") % 10 < 7).alias("g"))
    rows = ordinals.dense_ordinal(df, "key", ["g"]).collect()
    for g in (True, False):
        assert [r.ord for r in sorted((r for r in rows if r.g == g), key=lambda r: r.key)] == list(range(700 if g else 300))
    assert sorted(r.key for r in ordinals.dense_ordinal(df, "key", below=11).collect()) == [7 * i for i in range(11)]
    after = {(r.g, r.key): r.next for r in ordinals.cyclic_next(df, "key", ["g"]).collect()}
    keys = [i * 7 for i in range(1000) if i % 10 < 7]
    assert all(after[True, a] == b for a, b in zip(keys, keys[1:] + keys[:1]))


def test_zstd_lines_with_a_long_window(spark, tmp_path):
    docs = [json.dumps({"fen": START, "evals": [{"pvs": [{"line": "e2e4"}], "knodes": i}]}) for i in range(5000)]
    body = "\n".join([*docs, "{bad", "unfinished"]).encode()
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=28)
    out = io.BytesIO()
    with zstandard.ZstdCompressor(compression_params=params).stream_writer(out, closefd=False) as w:
        w.write(body)
    (tmp_path / "a.jsonl.zst").write_bytes(out.getvalue())
    lines = read_zstd_lines(spark, str(tmp_path / "*.zst"))
    assert lines.count() == 5001 and lines.agg(F.max("line_no")).first()[0] == 5000
    assert evals.decode_json(lines, "value", samples.EVAL_SCHEMA).count() == 5000


def test_plain_zstd_reader(spark, tmp_path):
    text = json.dumps({"fen": START, "evals": [{"pvs": [{"line": "e2e4"}]}]}) + "\n{bad\n"
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    assert [r.fen for r in evals.read_evals(spark, str(tmp_path)).collect()] == [START]


def test_viewer_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'id,fen,model_move,full_reply,legal,good\n1,f1, e4 ,"line one\nsaid ""x"", y",TRUE,true\n2,f2,e4,r,FALSE,true\n'
        "3,f3,e4,r\r\n4,f4\n5,f5,e4,r,,")
    rows = results.read_entries(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.fen, r.model_move, r.full_reply, r.good) for r in rows] == [
        ("f1", "e4", 'line one\nsaid "x", y', True), ("f3", "e4", "", False), ("f5", "e4", "r", False)]


def test_legal_list(spark):
    df = spark.createDataFrame([(1, "7k/8/6K1/8/8/8/8/8 b - -")], "id int, fen string")
    assert legal_san_list(df).first().legal_san == "Kg8"


def test_ordinals_of_any_key(spark):
    """Hashed keys, text, several columns, ties, nulls, and a group with most of the rows."""
    df = spark.range(3000).select(F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("t"), (F.col("id") % 7).alias("small"),
                                  F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("g"))
    rows = ordinals.dense_ordinal(df, "h").collect()
    assert [r.h for r in sorted(rows, key=lambda r: r.ord)] == sorted(r.h for r in rows)
    assert sorted(r.ord for r in rows) == list(range(3000))
    rows = ordinals.dense_ordinal(df, ["small", "t"], ["g"]).collect()
    for g, n in (("hot", 2700), ("cold", 150), (None, 150)):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(n)) and [(r.small, r.t) for r in own] == sorted((r.small, r.t) for r in own)
    assert ordinals.dense_ordinal(df.limit(0), "h").count() == 0


def test_gapless_numbers_of_hot_groups(spark):
    df = written(spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 40).alias("g")))
    rows = ordinals.gapless(df, ["g"], F.lit(5), "row").collect()
    for g in {r.g for r in rows}:
        assert sorted(r.slot for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_vocabulary_is_whole_and_rare_words_have_ids(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_WORDS", 2)
    texts = spark.createDataFrame([(1, "a a a b b c"), (2, "d b a new"), (3, "")], "k int, text string")
    vocab = tokens.vocabulary(texts.where("k < 3"), "text")
    ids = {r.word: r.token_id for r in vocab.collect()}
    assert ids == {"a": 2, "b": 3, "c": 4, "d": 5, "new": 6}
    assert [r.word for r in tokens.vocabulary(texts, "text", 2).orderBy("token_id").collect()] == ["a", "b"]
    got = {r.k: r.input_ids for r in tokens.tokenize_pad(texts, ["k"], "text", vocab.where("word <> 'new'"), 6).collect()}
    assert got == {1: [2, 2, 2, 3, 3, 4], 2: [5, 3, 2, 1, 0, 0], 3: [0] * 6}


LINES = [
    '{"fen": "%s", "evals": [{"pvs": [{"line": "e2e4", "cp": 12.5}], "knodes": 1, "depth": "x"}]}' % START,
    '{"fen": "%s", "evals": [{"pvs": [{"line": "d2d4"}]}, {"pvs": null}]}' % START,
    '{bad', "", "[1]",
    '{"fen": "%s", "evals": [{"pvs": [{"line": "d2d4 d7d5", "mate": 3}], "depth": 20}], "more": {"x": []}}' % START,
]


def test_misfit_numbers_lose_no_document(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES) + "\n")
    docs = evals.read_evals(spark, str(tmp_path / "a.jsonl"), keep_order=True)
    assert docs.count() == docs.select("fen").count() == docs.select("evals").count() == len(docs.collect()) == 3
    first, second, third = sorted(docs.collect(), key=lambda r: r.at)
    assert first.evals[0].pvs[0].cp is None and first.evals[0].depth is None and first.evals[0].knodes == 1
    assert second.evals is None and third.evals[0].pvs[0].mate == 3


def test_from_files_to_a_split(spark, tmp_path):
    """Two compressed files with bad and unfinished lines; the prefix follows the order of files and lines."""
    moves = ["e2e4", "d2d4", "g1f3", "c2c4", "zzzz"]
    for name in ("b", "a"):
        rows = [json.dumps({"fen": START, "evals": [{"pvs": [{"line": moves[i % 5]}]}]}) for i in range(40)]
        rows.insert(3, "{bad")
        body = "\n".join([*rows, '{"unfinished": 1']).encode()
        (tmp_path / f"{name}.jsonl.zst").write_bytes(zstandard.compress(body))
    docs = evals.decode_evals(evals.in_order(read_zstd_lines(spark, str(tmp_path / "*.zst")), "file", "line_no"))
    assert docs.count() == 80
    taken = splits.take_first_valid(docs, 40, "at")
    split = splits.sequential_split(taken, 30, 5, 10, "at").orderBy("ord").collect()
    assert [r.ord for r in split] == list(range(40)) and [r.split for r in split].count("test") == 5
    assert all("/a.jsonl" in r["at"] for r in split[:32]) and all("/b.jsonl" in r["at"] for r in split[32:])
    assert [r.best_move for r in split[:5]] == ["e4", "d4", "Nf3", "c4", "e4"]


def test_a_prefix_shuffles_no_document(spark, tmp_path):
    docs = spark.range(1000).select("id", F.lit(START).alias("fen"), F.expr(
        "array(named_struct('knodes', 1L, 'depth', 1, 'pvs', array(named_struct('cp', 1, 'mate', 1, 'line', 'e2e4'))))").alias("evals"))
    docs.write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    assert [r.id for r in splits.take_first_valid(table, 7, "id").orderBy("ord").collect()] == list(range(7))
    plan = table.where(F.col("id") <= F.lit(27)).select("id", "evals")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(id,27)" in plan and "Exchange" not in plan


def test_malformed_fens_have_no_moves(spark):
    fields = START.split()
    bad = [" ".join(fields[:1] + ["x"] + fields[2:]), START.replace("pppppppp", "44"), START.replace("KQkq", "ZZ"), START + " 0 1 2"]
    df = spark.createDataFrame([(i, f, "e4", ["e4"], "Best Move: e4") for i, f in enumerate([*bad, START])],
                               "id int, fen string, model_move string, top_moves array<string>, full_reply string")
    assert [r.id for r in legal_moves(df).select("id").distinct().collect()] == [4]
    assert {r.id for r in score_moves(df).where("legal").collect()} == {4}
    assert {r.id for r in reply_to_san(df.drop("model_move")).where("model_move <> ''").collect()} == {4}


def test_an_empty_result_leaves_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], "model string, id long, fen string, model_move string, full_reply string, legal boolean, good boolean, top_moves array<string>")
    write_results(empty, str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out")).count() == 0
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert text == ["id,fen,model_move,full_reply,legal,good,top_moves"]


def test_stop_rules_against_every_prefix(spark):
    import random

    rng = random.Random(8)
    parts = ["best move:", "Best", " Move", ":", " ", "\n", "N", "f3", "Nf3", "+", "x", "O-O", "-O", "e", "4", "e8=Q", "Qa1xb2=Q+", "#", "é", "word " * 5, "BEST MOVE: ", "a1"]
    rows = [(i, [rng.choice(parts) for _ in range(rng.randrange(12))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, pieces array<string>")
    stops = df.select("id", t.stop_index(F.col("pieces"), True).alias("marked"), t.stop_index(F.col("pieces"), False).alias("plain"))
    prefixes = df.select("id", F.explode(F.sequence(F.lit(1), F.size("pieces"))).alias("n"), "pieces").where("size(pieces) > 0").select(
        "id", "n", F.array_join(F.slice("pieces", F.lit(1), F.col("n")), "").alias("text"))
    after = rf"(?is){t.MARKER}.*{t._START}(?-i:{t.SAN_CORE}){t._BOUNDARY}"
    want = prefixes.groupBy("id").agg(F.min(F.when(F.rlike("text", F.lit(after)), F.col("n"))).alias("marked"),
                                      F.min(F.when(F.rlike("text", F.lit(t.SAN_TOKEN)), F.col("n"))).alias("plain"))
    want = {r.id: (r.marked, r.plain) for r in want.collect()}
    assert {r.id: (r.marked, r.plain) for r in stops.collect()} == {i: want.get(i, (None, None)) for i, _ in rows}
