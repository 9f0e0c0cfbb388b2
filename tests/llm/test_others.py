import gzip
import random
import time
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plyframe.llm import maxscore, mil, snapshots, templates, warc
from plyframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, pos string, h1 string"


def rows_of(table):
    names = sorted(table.columns)
    return sorted((tuple(r[c] for c in names) for r in table.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert rows_of(QUERIES[name](spark, SF)) == want


def test_snapshots_collapse(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None)]
    logged = {1: said[:1], 2: said[:2], 3: said, 4: said, 5: [("user", "a"), ("assistant", "x")], 6: [("user", "")], 7: [("user", None)],
              8: [("system", "a"), ("assistant", "b")]}
    rows = [(c, 10 * i, r, t, "", "") for c, turns in logged.items() for i, (r, t) in enumerate(turns)]
    rows += rows[:3] + [(None, 0, "user", "nobody", "", "")]
    table = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in snapshots.chat_records(table).collect()}
    assert {c: (r.n_turns, r.copies) for c, r in got.items()} == {3: (4, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1), 8: (2, 1)}
    assert got[5].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert snapshots.chat_records(table.limit(0)).count() == 0


def test_a_long_conversation_spans_blocks(spark):
    n = 3 << snapshots.BLOCK_BITS
    long = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.hash("id").cast("string").alias("text"))
    shifted = long.where(f"turn < {n - 5}").select(F.lit(2).alias("conv_id"), (F.col("turn") + 77).alias("turn"), "role", "text")
    assert [(r.conv_id, r.n_turns) for r in snapshots.chat_records(long.union(shifted)).collect()] == [(1, n)]


def test_snapshots_use_no_python(spark):
    plan = QUERIES["op4_chat_snapshots"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def brute(vectors, k):
    out = set()
    for q in sorted({i for i, x in vectors if i % 50 == 0 and x is not None}):
        query = min(x for i, x in vectors if i == q and x is not None)
        found = sorted((-sum(a * b for a, b in zip(query, x, strict=False)), i) for i, x in vectors if i != q and x is not None)
        out |= {(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("low,high", [(-9, 9), (0, 9), (-9, -1), (0, 1)])
def test_top_k_against_all(spark, low, high, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    rng = random.Random(low * 100 + high)
    vectors = [(i, [float(rng.randint(low, high)) if rng.random() < 0.5 else 0.0 for _ in range(24)]) for i in range(400)]
    table = spark.createDataFrame(vectors, "vec_id long, x array<double>")
    got = maxscore.top_k(table, "vec_id", "x", "id % 50 = 0")
    assert {tuple(r) for r in got.collect()} == brute(vectors, 5)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [3.0]), (7, []), (1, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, x array<double>, score string")
    got = [tuple(r) for r in maxscore.top_k(table, "vec_id", "x", "id % 50 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 6, 3), (0, 4, 7, 0)]
    assert maxscore.top_k(table.limit(0), "vec_id", "x", "id % 50 = 0").count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    """Products that doubles, or 64 bits, do not hold: exact scores, and exact ranks beyond 64 bits."""
    monkeypatch.setattr(maxscore, "SHARD", 16)
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-9, 9) * rng.choice([1, 1, 1, 10**7 + 1, 10**30])) for _ in range(6)]) for i in range(120)]
    got = maxscore.top_k(spark.createDataFrame(vectors, "vec_id long, x array<double>"), "vec_id", "x", "id % 50 = 0").collect()
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = set()
    for q in (0, 50, 100):
        found = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q][1], x, strict=True)), i) for i, x in vectors if i != q)
        want |= {(q, r + 1, i, limit(-s)) for r, (s, i) in enumerate(found[:5])}
    assert {tuple(r) for r in got} == want and any(abs(r[3]) > 2**60 for r in want)


def test_top_k_query_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (2, None), (3, [1.0, None]), (4, [nan, 9.0]), (5, [inf, 1.0]), (6, [-inf, 9.0]), (50, [nan, 1.0]),
            (None, [1.0, 1.0]), (7, [-0.3, 0.1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["op8_maxscore_top_k"]).fetchall())
    got = QUERIES["op8_maxscore_top_k"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want and [r[2] for r in want] == [1, 7]


def test_warc_round_trip(spark, tmp_path):
    source = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    records = QUERIES["op7_warc_derivatives"](spark, SF)
    rows = records.collect()
    assert Counter((r.page_id, r.warc_type) for r in rows) == Counter((i, k) for i in source for k in ("metadata", "conversion"))
    warc.write_warc(records, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.warc.gz"))
    assert files and sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)
    parsed = {h["warc-record-id"]: (h, b) for f in files for h, b in warc.records(gzip.open(f))}
    for r in rows:
        head, block = parsed[r.record_id]
        assert head["warc-refers-to"] == r.refers_to and head["warc-type"] == r.warc_type and head["warc-target-uri"] == source[r.page_id]["url"]
        assert block.decode() == r.block and len(block) == r.content_length and warc.digest(block) == head["warc-block-digest"]
    both = {r.page_id: r.refers_to for r in rows}
    assert all(both[r.page_id] == r.refers_to for r in rows) and len(set(both.values())) == len(source)
    page = next(r for r in rows if r.warc_type == "metadata")
    assert f"source-payload-digest: {warc.digest(source[page.page_id]['html'].encode())}" in page.block


def test_plain_text_of_pages():
    page = "<!DOCTYPE html><html lang=de><head><title>T &amp; t</title><style>p{}</style></head><body><!-- c --><p>a &lt;b&gt;\n c<br>d<script>x='</p>'</script><table><tr><td>1<td>2</table> 3 < 4"
    assert warc.plain_text(page) == "a <b> c\nd\n1 2\n3 < 4"
    assert warc.plain_text("") == "" and warc.plain_text("<script>never ends") == ""


def test_responses_of_files_keep_what_they_say(spark, tmp_path):
    def record(kind, number, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{number}>", "WARC-Date": f"2024-05-0{number}T00:00:00Z", "WARC-Target-URI": f"http://h/{number}",
                "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    first = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b\r\n\r\n<title>Caf\xe9</title><p>one\r\n\r\ntwo"
    made = [record("warcinfo", 1, b"x: y\r\n"), record("response", 2, first, **{"WARC-Payload-Digest": "sha1:OWN"}), record("request", 3, b"GET /\r\n\r\n"),
            record("response", 4, b"HTTP/1.1 404 No\r\nContent-Type: text/html; charset=nonsense\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(record("response", 5, b"HTTP/1.1 200 OK\r\n\r\n<html lang=de>x"))
    responses = warc.read_responses(spark, str(tmp_path)).withColumn("page_id", F.lit(1))
    out = warc.derivatives(responses, headers="headers", of={c: c for c in warc.KNOWN}).collect()
    assert {(r.refers_to, r.warc_type, r.date, r.title) for r in out} == {
        (f"<urn:uuid:{n}>", k, f"2024-05-0{n}T00:00:00Z", title) for n, title in ((2, "Café"), (4, None), (5, None)) for k in ("metadata", "conversion")}
    about = next(r for r in out if r.refers_to == "<urn:uuid:2>" and r.warc_type == "metadata")
    assert about.payload_digest == "sha1:OWN" and "source-x-a: b" in about.block and f"source-block-digest: {warc.digest(first)}" in about.block
    (tmp_path / "c.warc").write_bytes(made[1][:-20])
    with pytest.raises(Exception, match="ends before its length"):
        warc.read_responses(spark, str(tmp_path)).count()


def test_hostile_pages_take_linear_time():
    for part in ("<a ", "<title>", "<html ", "<!--", "<script>", "<p ", "</title "):
        start = time.time()
        warc.derived(1, "u", part * (2_000_000 // len(part)), "d", None)
        assert time.time() - start < 5, part


def test_warc_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "h"), (1, "u", "", None), (1, "u", "", None), (2, "u", "<p>x", "HTTP/1.1 404 No\r\nX-A: b\r\n")],
                                 "page_id long, url string, html string, block string")
    got = warc.derivatives(rows, headers="block").collect()
    assert len(got) == 8 and len({r.record_id for r in got if r.page_id == 1}) == 2
    assert "source-x-a: b" in next(r.block for r in got if r.page_id == 2 and r.warc_type == "metadata")
    assert warc.derivatives(rows.limit(0)).count() == 0


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = QUERIES["op5_mil_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    ranks = sum(1 for a in held for b in held if labels[a.doc_id] > labels[b.doc_id] and a.score > b.score)
    assert ranks / sum(1 for a in held for b in held if labels[a.doc_id] > labels[b.doc_id]) > 0.97


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (10, 1), (10, 0), (5, None), (None, 1), (9, 3)], "doc_id long, quality int")
    model = mil.fit(docs, labels, "doc_id", "text", "quality")
    rows = mil.scored(docs, model, "doc_id", "text").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert mil.accepted(docs, model, "text").columns == docs.columns
    for few in (labels.limit(0), labels.where("quality = 1")):
        constant = mil.fit(docs, few, "doc_id", "text", "quality")
        assert {r.score >= 0.5 for r in mil.scored(docs, constant, "doc_id", "text").collect()} == {True}
    assert mil.scored(empty, model, "doc_id", "text").count() == 0


def test_parts_of_a_long_text_are_its_whole():
    text = b"some words " * 300_000
    assert b"".join(mil.spans(text)) == text and all(len(s) <= mil.SPAN for s in mil.spans(text))
    assert b"".join(mil.spans(b"x" * 3_000_000)) == b"x" * 3_000_000


QUESTION = "Yesterday old Maria Lopez bought {} kg of sweet apples and sold {} kg to her brother Tom before noon, so how much was left?"


def test_reparameterised_questions_are_found(spark):
    other = QUESTION.replace("Maria Lopez", "Anna Meier").replace("Tom", "Karl")
    docs = spark.createDataFrame([
        (1, "Well then. " + QUESTION.format(12, 5) + " The end."), (2, other.format(31, 9)), (3, "nothing of the kind, only words that are in no item at all"),
        (4, None), (5, ""), (6, other.format(31, 31)), (7, QUESTION.format(12, 5)[:60]), (None, QUESTION.format(12, 5)), (1, "Well then. " + QUESTION.format(12, 5) + " The end."),
    ], "doc_id long, text string").withColumn("window", F.lit("extra")).withColumn("mark", F.lit("extra"))
    items = spark.createDataFrame([(1, QUESTION.format(12, 5)), (2, QUESTION.format(8, 8)), (3, None), (4, "too short"), (1, QUESTION.format(12, 5))],
                                  "item_id long, text string").withColumn("size", F.lit("extra"))
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 1), (2, 1), (6, 1), (6, 2)}
    assert templates.leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert templates.leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_names_that_open_sentences_and_short_items(spark):
    alice = "Alice has {} apples and {} pears. Alice eats 2 apples. Alice now has how many fruits left?"
    items = spark.createDataFrame([(1, alice.format(3, 4)), (2, "What is 12 times 7 plus 9?"), (3, "Yes, no"), (4, "3 5 7 9 11 13 15 17 19 21"),
                                   (5, "Bring seven cups of flour to the old mill before Tom wakes")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, alice.format(5, 4).replace("Alice", "Bob")), (2, "They ask: what is 12 times 7 plus 9? Well."), (3, "What is 12 times 8 plus 9?"), (4, "yes no"),
        (5, "Yes, no doubt"), (6, "now 3 5 7 9 11 13 15 17 19 21 and on"), (7, alice.format(5, 4).replace("Alice", "Bob", 1)),
        (8, "Bring three cups of flour to the old mill before Ann wakes"), (9, None), (10, ""), (11, "1 3 5 7 9 11 2 4 6")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 1), (2, 2), (4, 3), (6, 4), (8, 5)}


def brute_leaks(docs, items, share=0.5):
    """By the definition, on the templates of the operator: per alignment, values that stand for two take it out."""
    found = set()
    for d, (plain_d, kinds_d) in docs.items():
        for q, (plain_q, kinds_q) in items.items():
            good = [p for p in range(len(kinds_q) - 7) if sum(not k.startswith("<") and k != "" for k in kinds_q[p : p + 8]) >= 4]
            hit = set()
            for shift in range(-len(kinds_q), len(kinds_d)):
                places = [p for p in good if 0 <= p + shift <= len(kinds_d) - 8 and kinds_d[p + shift : p + shift + 8] == kinds_q[p : p + 8]]
                values: dict = {}
                for i in {i for p in places for i in range(p, p + 8) if kinds_q[i].startswith("<")}:
                    values.setdefault((kinds_q[i], plain_q[i]), set()).add(plain_d[i + shift])
                if all(len(v) == 1 for v in values.values()):
                    hit |= set(places)
            if good and len(hit) >= share * len(good):
                found.add((d, q))
    return found


def test_reparameterised_items_by_brute_force(spark):
    rng = random.Random(8)
    names, words = ["Ann", "Bob", "Cy", "Dora"], "buys sells pears at the market for old friends near rivers while rain falls".split()

    def text(n):
        return " ".join(rng.choice(names) if rng.random() < 0.15 else str(rng.randint(1, 4)) if rng.random() < 0.2 else rng.choice(words) for _ in range(n)) + "."

    items = [(i, text(14)) for i in range(6)]
    swap = lambda t: " ".join({"Ann": "Bob", "Bob": rng.choice(["Cy", "Ann"]), "1": "7", "2": rng.choice("24")}.get(w, w if rng.random() < 0.92 else "x") for w in t.split())
    docs = [(i, f"{text(5)} {swap(items[i % 6][1]) if i % 3 else items[i % 6][1]} {text(5)}") for i in range(60)]
    frames = [spark.createDataFrame(x, "k long, text string") for x in (docs, items)]
    cut = [{r.k: (r.plain, r.kinds) for r in f.select("k", F.split(templates.plain(templates.spaced(F.col("text"))), " ").alias("plain"),
                                                     templates.template(templates.spaced(F.col("text"))).alias("kinds")).collect()} for f in frames]
    got = {(r.doc_id, r.item_id) for r in templates.leaks(*frames, "k", "text", "k", "text").collect()}
    want = brute_leaks(*cut)
    assert got == want and 10 < len(want) < 60


def test_verbatim_items_are_found(spark):
    squeeze = lambda t: " ".join((t or "").split())
    docs = {r["doc_id"]: squeeze(r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    items = {r["item_id"]: squeeze(r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()}
    want = {(i, k) for i, t in docs.items() for k, q in items.items() if q in t}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op10_template_decontamination"](spark, "/root/testdata/sf0.01").collect()} == want


def test_templates_use_no_python(spark):
    plan = QUERIES["op10_template_decontamination"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages(spark, docs):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    packed = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r for r in source.collect()}
    assert {r.doc_id for r in packed} < set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, source, SF)
        assert after.columns == source.columns and after.dtypes == source.dtypes, name
        assert 0 < after.count() <= source.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_by_definition(spark):
    """Each stage against its operator's query on what the stages before it kept."""
    from test_near_duplicates import shingle_set
    from test_substrings import without

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    good = {r.doc_id for r in QUERIES["op5_mil_quality"](spark, SF).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == good
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    shingles = {i: shingle_set(t) for i, t in texts.items()}
    like = {(a, b) for a in texts for b in texts if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    gone = set(texts) - {r.doc_id for r in unique.select("doc_id").collect()}
    assert not {(a, b) for a, b in like if a not in gone and b not in gone} and gone <= {b for _, b in like} and gone
    texts = {r.doc_id: r.text for r in unique.collect()}
    cut = corpus_pipeline.repeated_passages(spark, unique, SF)
    ids = sorted(texts)
    want = without([texts[i].encode() for i in ids], 200)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {
        i: (t := k.decode("utf-8", "ignore"), len(t)) for i, (*_, k) in zip(ids, want, strict=True)}
