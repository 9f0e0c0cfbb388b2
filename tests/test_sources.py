"""Files read in parallel against a reader that goes through them character by character."""

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from plyframe.plans import zones
from plyframe.plans.scratch import written
from plyframe.sources import committed, csv_ranges, evals, results, zstd_frames
from plyframe.sources.zstd_lines import read_zstd_lines, write_zstd_lines


def by_character(text):
    """Records of quoted CSV: quotes toggle anywhere, doubled ones inside are kept, carriage returns outside are not."""
    records, record, field, inside, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"' and text[i + 1 : i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            inside = not inside
        elif not inside and c == ",":
            record, field = [*record, field], ""
        elif not inside and c == "\n":
            records.append([*record, field])
            record, field = [], ""
        elif inside or c != "\r":
            field += c
        i += 1
    return records + ([[*record, field]] if record or field else [])


@pytest.mark.parametrize("size", [13, 64, 1 << 20])
def test_records_of_any_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    parts = ['"', '""', ",", "\n", "\r\n", "a", "b c", "é漢", "￿", "￾1", ""]
    want = {}
    for i in range(6):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        text += rng.choice(["", "\n", '"open', ",x"])
        if text.count('"') % 2 and text.endswith("\n"):  # lines do not tell whether the last one is ended
            text += "x"
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        want[f"f{i}.csv"] = by_character(text)
    (tmp_path / "long.csv").write_text('id,text\n1,"' + "many\nlines, of\n" * 20 + '"\n2,short\n')
    want["long.csv"] = by_character((tmp_path / "long.csv").read_text())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = csv_ranges.read_records(spark, str(tmp_path))
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.file, r.block, r.line)):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.fields)
        blocks = spark.read.option("lineSep", "\n").text(str(tmp_path / "long.csv")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # a reader by lines sees no line after a last line feed, and one that is only a carriage return has an empty field
    strip = lambda records: [r for r in records if r != [""]]
    assert {k: strip(v) for k, v in got.items()} == {k: strip(v) for k, v in want.items() if strip(v) or k in got}
    assert blocks > 5 or size > 64


def test_headers_and_entries(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,fen,model_move,full_reply,legal,good\n1,f1,e4,"a, ""b""\nc",True,True\n\n2,f2,d4,x, FALSE ,True\n3,f3,c4\n4,f4\n')
    (tmp_path / "b.csv").write_text("fen,id\ng1,7\ng2")
    records = csv_ranges.read_records(spark, str(tmp_path))
    rows = csv_ranges.by_header(records, ["id", "fen", "full_reply"]).drop("file").collect()
    assert sorted(map(tuple, rows)) == [("", "g2", ""), ("1", "f1", 'a, "b"\nc'), ("2", "f2", "x"), ("3", "f3", ""), ("4", "f4", ""), ("7", "g1", "")]
    kept = csv_ranges.entries(records).select("fen", "model_move", "full_reply", "good").collect()
    assert sorted(map(tuple, kept)) == [("f1", "e4", 'a, "b"\nc', True), ("f3", "c4", "", False)]


def test_json_syntax(spark):
    good = ['{"fen": "f", "evals": []}', ' {"fen": "a}{\\"", "evals": [{"pvs": [{"line": "{"}]}]}\r']
    bad = ["{'fen': 'f', 'evals': []}", '{"fen": "f", "evals": []} trailing', '{"fen": "f"} {"fen": "g"}', '{"fen": "f"', "[1]", "", '{"fen": "f"}]', '{"fen": "f"}}']
    rows = spark.createDataFrame([(x,) for x in good + bad], "value string").union(
        spark.range(1).select(F.unhex(F.lit("7B2266656E223A22FF227D")).cast("string")))
    assert sorted(r.fen for r in evals.decode_evals(rows).collect()) == ["a}{\"", "f"]
    assert tuple(evals.reject_counts(rows, "value", "fen STRING").first()) == (11, 2, 9)


@pytest.mark.parametrize("frame", [None, 7, 100])
def test_frames_give_the_lines_of_the_file(spark, tmp_path, frame):
    rng = random.Random(frame or 0)
    rows = [(f"f{f}", i, "".join(rng.choice("abé漢 ") for _ in range(rng.randrange(60)))) for f in range(3) for i in range(40)]
    rows.append(("one", 0, "x" * 500))
    folder = str(tmp_path / "corpus")
    write_zstd_lines(spark.createDataFrame(rows, "file string, line long, value string"), folder, finished=frame != 100, frame_bytes=frame)
    index = written(zstd_frames.frame_index(spark, folder))
    assert index.count() == 4 if frame is None else index.count() > 20
    key = lambda r: (r.file.rsplit("/", 1)[1], r.line_no, r.value)
    found = zstd_frames.read_frames(spark, index, per_task=200)
    assert sorted(map(key, found.collect())) == sorted(map(key, read_zstd_lines(spark, folder).collect()))


def test_few_bytes_of_frames_are_work_for_several_tasks(spark, tmp_path, monkeypatch):
    """small frames, however many, went to one task each time, which counted, decoded and wrote all of them."""
    rows = [("f", i, f"{i} " * 100) for i in range(400)]
    write_zstd_lines(spark.createDataFrame(rows, "file string, line long, value string"), str(tmp_path), frame_bytes=2000)
    index = zstd_frames.frame_index(spark, str(tmp_path))
    assert index.select("offset", "feeds").count() > 40
    seen = []

    def kept(df):
        seen.append(written(df.withColumn("task", F.spark_partition_id())))
        return seen[-1]

    monkeypatch.setattr(zstd_frames, "written", kept)
    found = zstd_frames.read_frames(spark, written(index))
    assert seen[-1].select("task").distinct().count() > 1
    assert sorted((r.line_no, r.value) for r in found.collect()) == [(i, v) for _, i, v in rows]


def test_frames_of_bad_text_and_skipped_frames(spark, tmp_path):
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    data = pack(b"a\nb\xff\n\xe6") + (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"xyz" + pack(b"") + pack(b"\xbc\xa2\nlast")
    (tmp_path / "x.zst").write_bytes(data + pack(b"\x00" * 300_000 + b"\n"))
    lines = {r.line_no: r.value for r in zstd_frames.read_frames(spark, written(zstd_frames.frame_index(spark, str(tmp_path)))).collect()}
    assert lines == {0: "a", 1: None, 2: "漢", 3: "last" + "\x00" * 300_000}


def test_zones_keep_numbers(spark, tmp_path):
    folder, rng = str(tmp_path / "zoned"), random.Random(3)
    even = lambda d: d.where("id % 3 > 0").withColumn("double", F.col("id") * 2)
    batches = [rng.sample(range(1000), 300), rng.sample(range(500, 2000), 200), [], [5]]
    want = []
    for ids in batches:
        zones.append(spark.createDataFrame([(i,) for i in ids], "id long"), folder, "id", even, zone_rows=64)
        want += [i for i in sorted(ids) if i % 3]
    rows = zones.numbered(spark, folder, "id").collect()
    assert sorted((r.ord, r.id, r.double) for r in rows) == [(n, i, 2 * i) for n, i in enumerate(want)]
    part = zones.numbered(spark, folder, "id", 10, 25)
    assert sorted((r.ord, r.id) for r in part.collect()) == list(enumerate(want))[10:25]
    plan = part._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "PushedFilters: [IsNotNull(_zone), GreaterThanOrEqual(_zone,0)" in plan


def test_files_appear_when_all_tasks_are_done(spark, tmp_path):
    folder = tmp_path / "out"
    lines = spark.range(300).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.col("id").alias("line"), F.col("id").cast("string").alias("value"))
    committed.write_committed(lines, str(folder))
    assert [int(x) for x in (folder / "f1").read_text().split()] == list(range(1, 300, 3))
    failing = lines.select(F.concat(F.lit("g"), "file").alias("file"), "line", F.when(
        F.col("line") == 299, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="no"):
        committed.write_committed(failing, str(folder))
    assert sorted(p.name for p in folder.iterdir() if p.is_file()) == ["f0", "f1", "f2"] and not list((folder / "_drafts").iterdir())


def test_evaluations_under_their_names(spark, tmp_path):
    rows = [("a/b:1", i, "f", "e4", 'said "x",\ny', i % 2 == 0, False, ["e4", "d4"]) for i in range(5)]
    scored = spark.createDataFrame(rows, "model string, id long, fen string, model_move string, full_reply string, legal boolean, good boolean, top_moves array<string>")
    results.write_evaluations(scored, spark.createDataFrame([("a/b:1",), ("none",)], "model string"), str(tmp_path / "r"), rows_per_file=3)
    results.write_manifest(spark.createDataFrame([("m", 5)], "base_model string, epochs int"), str(tmp_path / "r"))
    files = {p.name: p.read_text() for p in (tmp_path / "r").iterdir() if p.is_file()}
    assert set(files) == {"evaluate_a_b_1.csv", "evaluate_a_b_1.1.csv", "evaluate_none.csv", "summary_a_b_1.json", "training_info.json"}
    header = "id,fen,model_move,full_reply,legal,good,top_moves\n"
    line = lambda i: f'{i},f,e4,"said ""x"",\ny",{i % 2 == 0},False,"e4,d4"\n'
    assert files["evaluate_a_b_1.csv"] == header + line(0) + line(1) + line(2) and files["evaluate_none.csv"] == header
    assert json.loads(files["summary_a_b_1.json"])["legal_move_rate"] == 60.0 and json.loads(files["training_info.json"])["epochs"] == 5
