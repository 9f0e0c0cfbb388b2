"""Queries over replies, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.functions import text as t
from plyframe.operators import replies as rep
from plyframe.operators import reports, samples, scoring
from plyframe.operators.correlation import rank_correlation
from plyframe.plans.scratch import scratch_folder, written
from plyframe.queries import fixtures as fx
from plyframe.queries.registry import ORACLES, query
from plyframe.sources import csv_ranges, results
from plyframe.streaming.rates import keep_rates, latest_rates, read_timed_replies, running_rates
from plyframe.streaming.state import partitions_of, state_in_files
from plyframe.streaming.stops import read_pieces, stop_stream

# The move token as RE2 can say it: with a check mark before a word character, else without.
_W = r"\pL\pN_"
_CORE = "[KQRNB]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRNB])?"
_RE = rf"(?:^|[^{_W}])(?:({_CORE}[+#])[{_W}]|(O-O-O|O-O|{_CORE})(?:$|[^{_W}]))"


def _first(text: str) -> str:
    return f"(regexp_extract({text}, '{_RE}', 1) || regexp_extract({text}, '{_RE}', 2))"


def scored(spark, sf):
    """model, id, fen, model_move, full_reply, legal, good, top_moves of every valid sample's replies."""
    valid = samples.valid_samples(fx.documents(spark, sf), "pos_id").withColumnRenamed("pos_id", "id")
    return scoring.evaluate_replies(valid, fx.replies(spark, sf))


_WINDOW = r"""CASE WHEN regexp_matches(full_reply, '(?i)best move:')
  THEN regexp_replace(regexp_extract(full_reply, '(?is)^.*best move:(.*)$', 1), '^\s+|\s+$', '', 'g') ELSE '' END"""
_TEXTS = "texts AS (SELECT concat('r', id, model) AS key, full_reply FROM fx_replies UNION ALL" \
         " SELECT concat('d', doc_id), concat(text, chr(10), 'Best move: ', text) FROM documents)"


def _texts(spark, sf):
    """Replies, and prose with a marker behind it."""
    docs = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("key"),
        F.concat("text", F.lit("\nBest move: "), "text").alias("full_reply"))
    return fx.replies(spark, sf).select(F.concat(F.lit("r"), "id", "model").alias("key"), "full_reply").unionByName(docs)


@query("marker_window", f"WITH {fx.SQL_REPLIES}, {_TEXTS} SELECT key, {_WINDOW} AS win FROM texts")
def marker_window(spark, sf):
    return _texts(spark, sf).select("key", t.marker_window(F.col("full_reply")).alias("win"))


@query("san_extract", f"WITH {fx.SQL_REPLIES}, {_TEXTS} SELECT key, {_first('full_reply')} AS san FROM texts")
def san_extract(spark, sf):
    return _texts(spark, sf).select("key", t.first_san(F.col("full_reply")).alias("san"))


@query("strip_check_suffix", f"""WITH {fx.SQL_REPLIES} SELECT id, model,
  regexp_replace(trim(coalesce(san, 'x+#')), '[+#]+$', '') AS cleaned FROM fx_replies""")
def strip_check_suffix(spark, sf):
    rows = fx.positions(spark, sf, "sans").select(
        F.col("pos_id").alias("id"), F.expr("explode(array('org/model-a:1', 'org/model-b'))").alias("model"),
        F.expr("concat(' ', coalesce(sans[CAST((pos_id DIV 12) % 6 AS INT)], 'x+#'), ' ')").alias("san"))
    return rows.select("id", "model", t.strip_check_suffix(F.col("san")).alias("cleaned"))


def _cut_sql(lead: str) -> str:
    pattern = rf"(?s)^({lead}(?:|.*?[^{_W}])(?:{_CORE}[+#]))[{_W}]|^({lead}(?:|.*?[^{_W}])(?:O-O-O|O-O|{_CORE}))(?:$|[^{_W}])"
    one, two = (f"regexp_extract(full_reply, '{pattern}', {g})" for g in (1, 2))
    return f"CASE WHEN {one} || {two} = '' THEN full_reply ELSE {one} || {two} END"


@query("truncate_after_marker", f"WITH {fx.SQL_REPLIES} SELECT id, model, {_cut_sql('(?i:.*?best move:)')} AS cut FROM fx_replies")
def truncate_after_marker(spark, sf):
    return fx.replies(spark, sf).select("id", "model", t.truncate_after_san(F.col("full_reply"), True).alias("cut"))


@query("truncate_after_san", f"WITH {fx.SQL_REPLIES} SELECT id, model, {_cut_sql('')} AS cut FROM fx_replies")
def truncate_after_san(spark, sf):
    return fx.replies(spark, sf).select("id", "model", t.truncate_after_san(F.col("full_reply"), False).alias("cut"))


def _stop_sql(condition: str) -> str:
    return f"""WITH {fx.SQL_REPLIES}, pieces AS (
  SELECT id, model, regexp_extract_all(full_reply, '\\s*\\S+') AS p FROM fx_replies),
prefixes AS (SELECT id, model, n, array_to_string(p[1:n], '') AS t FROM pieces CROSS JOIN unnest(range(1, len(p) + 1)) AS g(n))
SELECT r.id, r.model, CAST(s.stop AS INT) AS stop FROM pieces r LEFT JOIN (
  SELECT id, model, min(n) AS stop FROM prefixes WHERE {condition} GROUP BY id, model) s ON s.id = r.id AND s.model = r.model"""


@query("stop_rule_marker", _stop_sql(
    f"regexp_matches(lower(t), 'best move:') AND {_first('''substr(t, CAST(strpos(lower(t), 'best move:') + 10 AS INT))''')} <> ''"))
def stop_rule_marker(spark, sf):
    pieces = F.regexp_extract_all("full_reply", F.lit(r"(\s*\S+)"), F.lit(1))
    return fx.replies(spark, sf).select("id", "model", t.stop_index(pieces, True).alias("stop"))


@query("stop_rule_san", _stop_sql(f"{_first('t')} <> ''"))
def stop_rule_san(spark, sf):
    pieces = F.regexp_extract_all("full_reply", F.lit(r"(\s*\S+)"), F.lit(1))
    return fx.replies(spark, sf).select("id", "model", t.stop_index(pieces, False).alias("stop"))


def _stopped_stream(spark, sf, after_marker):
    """Pieces of all replies in three lots of files, a reply's pieces shuffled over them, read as three batches of a stream."""
    pieces = fx.replies(spark, sf).select("model", "id", F.regexp_extract_all("full_reply", F.lit(r"(\s*\S+)"), F.lit(1)).alias("all"))
    # outer, as before an inner one the optimizer puts a filter that finds all pieces twice more
    pieces = pieces.select("model", "id", F.posexplode_outer("all").alias("idx", "piece"), F.size("all").alias("of")).where("idx IS NOT NULL")
    pieces = pieces.select("model", "id", "idx", "piece", (F.col("idx") == F.col("of") - 1).alias("last"))
    source, out, state = (scratch_folder(spark) for _ in range(3))
    for part in range(3):
        pieces.where(F.pmod(F.xxhash64("id", "idx"), F.lit(3)) == part).write.mode("append").json(source)
    # positions are dealt to as many tasks as there are cores, and each writes a file
    stops = stop_stream(read_pieces(spark, source, files_per_batch=spark.sparkContext.defaultParallelism), after_marker, silence=None)
    with state_in_files(spark):
        run = stops.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stops.schema).parquet(out).select("id", "model", "stop")


@query("stop_rule_stream", ORACLES["stop_rule_marker"])
def stop_rule_stream(spark, sf):
    return _stopped_stream(spark, sf, True)


@query("stop_rule_san_stream", ORACLES["stop_rule_san"])
def stop_rule_san_stream(spark, sf):
    return _stopped_stream(spark, sf, False)


def _with_failures(spark, sf):
    """Samples of which some have a malformed FEN, replies to all of them, and a model that answered only those."""
    bad = F.col("id") % 7 == 0
    valid = samples.valid_samples(fx.documents(spark, sf), "pos_id").withColumnRenamed("pos_id", "id")
    failing = valid.withColumn("fen", F.when(bad, F.concat(F.lit("9"), "fen")).otherwise(F.col("fen")))
    said = fx.replies(spark, sf).select("model", "id", "full_reply")
    more = said.where(bad & (F.col("model") == "org/model-b")).withColumn("model", F.lit("org/none:0"))
    return failing, said.union(more)


@query("evaluate_skips_failed", f"""WITH {fx.SQL_SCORED}
SELECT model, id, model_move, legal, good FROM fx_scored WHERE id % 7 <> 0""")
def evaluate_skips_failed(spark, sf):
    return scoring.evaluate_replies(*_with_failures(spark, sf)).select("model", "id", "model_move", "legal", "good")


@query("evaluation_files", f"""WITH {fx.SQL_SCORED}, good AS (SELECT * FROM fx_scored WHERE id % 7 <> 0)
SELECT concat('evaluate_', replace(replace(model, '/', '_'), ':', '_'), '.csv') AS file, count(*) AS n,
  count(*) FILTER (WHERE legal) AS legal, count(*) FILTER (WHERE good) AS good, bit_xor(id) AS ids FROM good GROUP BY model
UNION ALL SELECT 'evaluate_org_none_0.csv', 0, 0, 0, 0
UNION ALL SELECT concat('summary_', replace(replace(model, '/', '_'), ':', '_'), '.json'), count(*), count(*) FILTER (WHERE legal),
  count(*) FILTER (WHERE good), 0 FROM good GROUP BY model""")
def evaluation_files(spark, sf):
    """What the viewer finds in the folder, by file name: rows, legal and good ones of the tables, and the same from the summaries."""
    folder = scratch_folder(spark)
    asked, said = _with_failures(spark, sf)
    results.write_evaluations(scoring.evaluate_replies(asked, said), said.select("model").distinct(), folder)
    base = F.regexp_extract("file", "[^/]+$", 0).alias("file")
    records = csv_ranges.read_records(spark, folder + "/*.csv")
    rows = csv_ranges.by_header(records, ["id", "legal", "good"]).select(
        base, F.lit(1).alias("n"), (F.col("legal") == "True").cast("int").alias("legal"), (F.col("good") == "True").cast("int").alias("good"),
        F.col("id").cast("long").alias("ids"))
    files = records.select(base, *(F.lit(0).cast(k).alias(c) for c, k in (("n", "int"), ("legal", "int"), ("good", "int"), ("ids", "long"))))
    tables = rows.union(files).groupBy("file").agg(*(F.sum(c).alias(c) for c in ("n", "legal", "good")), F.expr("bit_xor(ids)").alias("ids"))
    found = spark.read.option("multiLine", True).schema("model STRING, test_samples BIGINT, legal_move_rate DOUBLE, top_move_rate DOUBLE").json(folder + "/*.json")
    count = lambda c: F.round(F.col("test_samples") * F.col(c) / 100).cast("long")
    return tables.union(found.select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0), "test_samples", count("legal_move_rate"),
                                     count("top_move_rate"), F.lit(0).cast("long")))


@query("reply_to_san", f"WITH {fx.SQL_REPLIES} SELECT model, id, model_move FROM fx_parsed")
def reply_to_san(spark, sf):
    return rep.reply_to_san(fx.replies(spark, sf)).select("model", "id", "model_move")


@query("reply_to_san_anywhere", f"WITH {fx.SQL_REPLIES} SELECT model, id, any_move AS model_move FROM fx_parsed")
def reply_to_san_anywhere(spark, sf):
    return rep.reply_to_san(fx.replies(spark, sf), use_marker=False).select("model", "id", "model_move")


@query("unparsed_replies", f"""WITH {fx.SQL_REPLIES} SELECT model, count(*) AS replies,
  count(*) FILTER (WHERE model_move = '') AS unparsed FROM fx_parsed GROUP BY model""")
def unparsed_replies(spark, sf):
    return rep.unparsed_replies(rep.reply_to_san(fx.replies(spark, sf)))


@query("xml_reply_parse", f"""WITH {fx.SQL_REPLIES} SELECT model, id,
  CASE WHEN shape = 7 THEN concat('the best move for White is ', coalesce(san, '?')) ELSE '' END AS choose,
  CASE WHEN shape = 7 THEN coalesce(regexp_replace(san, '[+#]+$', ''), '') ELSE '' END AS chosen,
  CASE WHEN shape = 7 AND san IS NOT NULL THEN 1 ELSE 0 END AS n_moves, false AS several_moves FROM fx_replies""")
def xml_reply_parse(spark, sf):
    return rep.parse_tags(fx.replies(spark, sf)).select("model", "id", "choose", "chosen", "n_moves", "several_moves")


@query("two_line_check", f"""WITH {fx.SQL_REPLIES} SELECT model, id, shape = 0 AS has_reasoning,
  CASE WHEN shape = 0 THEN 3 ELSE 0 END AS reasoning_words,
  shape IN (0, 2, 3, 5, 6) AS has_move_line, shape = 0 AS well_formed FROM fx_replies""")
def two_line_check(spark, sf):
    rows = fx.replies(spark, sf)
    return rows.select("model", "id", t.two_line_check(F.col("full_reply")).alias("c")).select("model", "id", "c.*")


# Structured replies with all five tags: one move, two moves, or none in `choose`.
_TAGGED = """asked AS (SELECT p.pos_id, p.fen, a.san AS a, b.san AS b FROM fx_positions p
  JOIN fx_moves a ON a.k = p.k AND a.j = (p.pos_id // 12) % 6 JOIN fx_moves b ON b.k = p.k AND b.j = (p.pos_id // 12 + 1) % 6),
named AS (SELECT *, coalesce(regexp_replace(a, '[+#]+$', ''), '') AS first, coalesce(regexp_replace(b, '[+#]+$', ''), '') AS second FROM asked)"""


@query("xml_reply_cases", f"""WITH {fx.SQL_POSITIONS}, {fx.SQL_MOVES}, {_TAGGED}
SELECT pos_id, concat('FEN: ', fen) AS board_position, 'equal' AS evaluate, concat(coalesce(a, '?'), ', ', coalesce(b, '?')) AS perceive,
  coalesce(b, '?') AS predict,
  CASE pos_id % 3 WHEN 0 THEN concat('the best move is ', coalesce(a, '?')) WHEN 1 THEN concat('either ', coalesce(a, '?'), ' or ', coalesce(b, '?')) ELSE '' END AS choose,
  CASE pos_id % 3 WHEN 0 THEN first WHEN 1 THEN CASE WHEN first <> '' THEN first ELSE second END ELSE '' END AS chosen,
  CASE pos_id % 3 WHEN 0 THEN CAST(first <> '' AS INT) WHEN 1 THEN CAST(first <> '' AS INT) + CAST(second <> '' AS INT) ELSE 0 END AS n_moves,
  pos_id % 3 = 1 AND first <> '' AND second <> '' AS several_moves FROM named""")
def xml_reply_cases(spark, sf):
    rows = fx.positions(spark, sf, "sans").selectExpr(
        "pos_id", "fen", "coalesce(sans[CAST((pos_id DIV 12) % 6 AS INT)], '?') AS a", "coalesce(sans[CAST((pos_id DIV 12 + 1) % 6 AS INT)], '?') AS b")
    reply = F.expr("""concat('<board_position>FEN: ', fen, '</board_position>\n<evaluate>equal</evaluate>\n<perceive>', a, ', ', b,
      '</perceive>\n<predict>', b, '</predict>\n', CASE pos_id % 3 WHEN 0 THEN concat('<choose>the best move is ', a, '</choose>')
      WHEN 1 THEN concat('<choose>either ', a, ' or ', b, '</choose>') ELSE 'no choice' END)""")
    return rep.parse_tags(rows.select("pos_id", reply.alias("full_reply"))).drop("full_reply")


@query("two_line_cases", """SELECT o_orderkey AS id, true AS has_reasoning, CAST(o_orderkey % 20 AS INT) AS reasoning_words,
  o_orderkey % 3 <> 0 AS has_move_line, o_orderkey % 3 <> 0 AND o_orderkey % 20 <= 15 AS well_formed FROM orders""")
def two_line_cases(spark, sf):
    reply = F.expr("concat('My reasoning: ', repeat('word ', CAST(o_orderkey % 20 AS INT)), '\nBest Move:', IF(o_orderkey % 3 = 0, '', ' e4'))")
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), t.two_line_check(reply).alias("c"))
    return rows.select("id", "c.*")


# Text against a position, legal or not: the SAN itself or the UCI, against the sample's top moves.
@query("score_moves", f"""WITH {fx.SQL_TOP} SELECT s.pos_id, m.j, CASE WHEN s.pos_id % 3 = 0 THEN m.uci ELSE coalesce(m.san, '') END AS move,
  m.san IS NOT NULL AS legal,
  list_contains(string_split(s.top_moves, ','), CASE WHEN s.pos_id % 3 = 0 THEN m.uci ELSE coalesce(m.san, '') END) AS good
FROM fx_samples s JOIN fx_moves m ON m.k = s.k""")
def score_moves(spark, sf):
    valid = samples.valid_samples(fx.documents(spark, sf), "pos_id").select("pos_id", "top_moves")
    asked = fx.positions(spark, sf, "ucis", "sans").select(
        "pos_id", "fen", F.posexplode(F.arrays_zip("ucis", "sans")).alias("j", "m"))
    rows = asked.select("pos_id", "fen", "j", F.expr(
        "CASE WHEN pos_id % 3 = 0 THEN m.ucis ELSE coalesce(m.sans, '') END").alias("move")).join(valid, "pos_id")
    return scoring.score_moves(rows, "move").select("pos_id", "j", "move", "legal", "good")


@query("evaluate_replies", f"""WITH {fx.SQL_SCORED}
SELECT model, id, fen, model_move, full_reply, legal, good, top_moves FROM fx_scored""")
def evaluate_replies(spark, sf):
    return scored(spark, sf).withColumn("top_moves", F.array_join("top_moves", ","))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RATES = """count(*) AS test_samples, round(avg(CAST(legal AS INT)) * 100, 6) AS legal_move_rate,
  round(avg(CAST(good AS INT)) * 100, 6) AS top_move_rate"""


@query("move_rates", f"WITH {fx.SQL_SCORED} SELECT model, {_RATES} FROM fx_scored GROUP BY model")
def move_rates(spark, sf):
    return _rounded(scoring.move_rates(scored(spark, sf), "model"), "legal_move_rate", "top_move_rate")


@query("running_rates", ORACLES["move_rates"])
def rates_of_stream(spark, sf):
    """The replies in three lots of files, each with some of the last lot's again, read as three batches of a stream."""
    valid = samples.valid_samples(fx.documents(spark, sf), "pos_id").withColumnRenamed("pos_id", "id")
    valid = written(scoring.positioned_samples(valid))
    said = fx.replies(spark, sf).select("model", "id", "full_reply", F.expr("timestamp_seconds(1700000000 + 60 * (id % 3))").alias("at"))
    source, out, state = (scratch_folder(spark) for _ in range(3))
    for part in range(3):
        again = (F.col("id") % 3 == part - 1) & (F.col("id") % 5 == 0)
        said.where((F.col("id") % 3 == part) | again).write.mode("append").json(source)
    # positions are dealt to as many tasks as there are cores, and each writes a file
    rates = running_rates(read_timed_replies(spark, source, files_per_batch=spark.sparkContext.defaultParallelism), valid, positioned=True)
    with state_in_files(spark, partitions_of(spark, source)):
        run = keep_rates(rates, out, state).trigger(availableNow=True).start()
    run.awaitTermination()
    return _rounded(latest_rates(spark, out), "legal_move_rate", "top_move_rate")


@query("model_summary", f"WITH {fx.SQL_SCORED} SELECT model, {_RATES} FROM fx_scored GROUP BY model")
def model_summary(spark, sf):
    return _rounded(scoring.model_summary(scored(spark, sf)).drop("timestamp"), "legal_move_rate", "top_move_rate")


@query("empty_guard", f"WITH {fx.SQL_SCORED} SELECT {_RATES}, count(*) > 0 AS has_results FROM fx_scored WHERE model = 'no such model'")
def empty_guard(spark, sf):
    return scoring.guarded_rates(scored(spark, sf).where("model = 'no such model'"))


@query("topn_rates", f"""WITH {fx.SQL_SCORED} SELECT model,
  round(avg(CAST(coalesce(list_position(string_split(top_moves, ','), model_move), 0) = 1 AS INT)) * 100, 6) AS best_move_rate,
  round(avg(CAST(coalesce(list_position(string_split(top_moves, ','), model_move), 0) BETWEEN 1 AND 3 AS INT)) * 100, 6) AS top_n_rate
FROM fx_scored GROUP BY model""")
def topn_rates(spark, sf):
    return _rounded(scoring.topn_rates(scored(spark, sf), 3), "best_move_rate", "top_n_rate")


_PV_ROWS = """pv AS (SELECT l.l_orderkey AS pos_id, p.fen, CAST(l.l_partkey % 600 - 300 AS INT) AS cp,
  CASE WHEN l.l_suppkey % 29 = 0 THEN CAST(l.l_linenumber - 4 AS INT) END AS mate, l.l_quantity AS x
  FROM lineitem l JOIN fx_positions p ON p.pos_id = l.l_orderkey)"""
_BUCKET = """CASE WHEN score > 100 THEN 'winning' WHEN score < -100 THEN 'losing' ELSE 'equal' END"""
_SCORE = """(CASE WHEN split_part(fen, ' ', 2) = 'b' THEN -1 ELSE 1 END)
  * CASE WHEN mate > 0 THEN 101 WHEN mate <= 0 THEN -101 ELSE cp END"""


def _pv_rows(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pos_id"), F.expr("CAST(l_partkey % 600 - 300 AS INT)").alias("cp"),
        F.expr("IF(l_suppkey % 29 = 0, CAST(l_linenumber - 4 AS INT), NULL)").alias("mate"), F.col("l_quantity").alias("x"))
    return lines.join(fx.positions(spark, sf), "pos_id")


@query("eval_bucket", f"""WITH {fx.SQL_POSITIONS}, {_PV_ROWS}
SELECT pos_id, cp, mate, {_BUCKET} AS bucket FROM (SELECT *, {_SCORE} AS score FROM pv)""")
def eval_bucket(spark, sf):
    white = ~F.contains("fen", F.lit(" b "))
    return _pv_rows(spark, sf).select("pos_id", "cp", "mate", t.eval_bucket(F.col("cp"), F.col("mate"), white).alias("bucket"))


@query("cp_correlation", f"""WITH {fx.SQL_POSITIONS}, {_PV_ROWS}
SELECT CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END AS side, round(corr(x, cp), 6) AS correlation, count(*) AS n
FROM pv GROUP BY 1""")
def cp_correlation(spark, sf):
    rows = _pv_rows(spark, sf).withColumn("side", F.when(F.contains("fen", F.lit(" b ")), "Black").otherwise("White"))
    return _rounded(scoring.cp_correlation(rows, "x", "cp", "side"), "correlation")


@query("cp_rank_correlation", f"""WITH {fx.SQL_POSITIONS}, {_PV_ROWS},
cells AS (SELECT CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END AS side, x, cp, count(*) AS n FROM pv GROUP BY ALL),
xs AS (SELECT DISTINCT side, x AS x0 FROM cells),
counted AS (SELECT c.side, x0, cp, sum(CASE WHEN x = x0 THEN n ELSE 0 END) AS own, sum(CASE WHEN x > x0 THEN n ELSE 0 END) AS upper
  FROM cells c JOIN xs ON xs.side = c.side GROUP BY ALL),
run AS (SELECT *, coalesce(sum(upper) OVER (PARTITION BY side, x0 ORDER BY cp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(upper) OVER (PARTITION BY side, x0) AS total FROM counted),
pairs AS (SELECT side, CAST(sum(own * (total - below - upper)) AS BIGINT) AS concordant, CAST(sum(own * below) AS BIGINT) AS discordant FROM run GROUP BY side),
tx AS (SELECT side, sum(t) AS n, sum(t * (t - 1) / 2) AS ties FROM (SELECT side, x, sum(n) AS t FROM cells GROUP BY ALL) GROUP BY side),
ty AS (SELECT side, sum(t * (t - 1) / 2) AS ties FROM (SELECT side, cp, sum(n) AS t FROM cells GROUP BY ALL) GROUP BY side)
SELECT pairs.side, CAST(tx.n AS BIGINT) AS n, concordant, discordant, round(CAST(concordant - discordant AS DOUBLE)
  / (sqrt(tx.n * (tx.n - 1) / 2 - tx.ties) * sqrt(tx.n * (tx.n - 1) / 2 - ty.ties)), 6) AS correlation
FROM pairs JOIN tx ON tx.side = pairs.side JOIN ty ON ty.side = pairs.side""")
def cp_rank_correlation(spark, sf):
    rows = _pv_rows(spark, sf).withColumn("side", F.when(F.contains("fen", F.lit(" b ")), "Black").otherwise("White"))
    found = rank_correlation(rows, "x", "cp", "side").withColumns({c: F.col(c).cast("long") for c in ("concordant", "discordant")})
    return _rounded(found, "correlation")


@query("rate_by_position_type", f"""WITH {fx.SQL_SCORED}, typed AS (
  SELECT *, CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END AS side, {_BUCKET} AS bucket
  FROM (SELECT *, {_SCORE} AS score FROM (SELECT *, CAST(id % 600 - 300 AS INT) AS cp, CAST(NULL AS INT) AS mate FROM fx_scored)))
SELECT model, bucket, side, count(*) AS n, round(avg(CAST(legal AS INT)) * 100, 6) AS legal_rate,
  round(avg(CAST(good AS INT)) * 100, 6) AS good_rate, round(stddev_pop(CAST(legal AS INT)), 6) AS legal_stddev
FROM typed GROUP BY ROLLUP (model, bucket, side)""")
def rate_by_position_type(spark, sf):
    rows = scored(spark, sf).withColumns({
        "cp": F.expr("CAST(id % 600 - 300 AS INT)"), "mate": F.lit(None).cast("int")})
    return _rounded(scoring.rate_by_position_type(rows), "legal_rate", "good_rate", "legal_stddev")


@query("results_analysis", f"""WITH {fx.SQL_RESULTS} SELECT model, count(*) AS total_moves,
  count(*) FILTER (WHERE lower(trim(legal)) = 'true') AS legal_moves, count(*) FILTER (WHERE lower(trim(good)) = 'true') AS good_moves,
  round(100.0 * count(*) FILTER (WHERE lower(trim(legal)) = 'true') / count(*), 2) AS legal_percentage,
  round(100.0 * count(*) FILTER (WHERE lower(trim(good)) = 'true') / count(*), 2) AS good_percentage
FROM fx_results GROUP BY model""")
def results_analysis(spark, sf):
    return reports.results_analysis(fx.results(spark, sf), "model")


# Few-shot and fine-tuned runs: every label is a scored move of one of six models in one phase.
_RUNS = """runs AS (SELECT concat('model-', doc_id % 6) AS model, CASE WHEN doc_id // 6 % 2 = 0 THEN 'few_shot' ELSE 'fine_tuned' END AS phase,
  count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS legal, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS best
  FROM labels GROUP BY 1, 2),
wide AS (SELECT model, {cols} FROM runs GROUP BY model)""".format(cols=", ".join(
    f"CAST(sum({w}) FILTER (WHERE phase = '{p}') AS BIGINT) AS {p}_{w}, "
    f"round(CAST(100 * sum({w}) FILTER (WHERE phase = '{p}') AS DOUBLE) / sum(n) FILTER (WHERE phase = '{p}'), 1) AS {p}_{w}_pct"
    for p in ("few_shot", "fine_tuned") for w in ("legal", "best")))


def _pivot(spark, sf):
    runs = fx.table(spark, sf, "labels").groupBy(
        F.expr("concat('model-', doc_id % 6)").alias("model"),
        F.expr("IF(doc_id DIV 6 % 2 = 0, 'few_shot', 'fine_tuned')").alias("phase"),
    ).agg(F.count("*").alias("n"), F.sum(F.expr("IF(quality = 1, 1, 0)")).alias("legal"),
          F.sum(F.expr("IF(toxic = 1, 1, 0)")).alias("best"))
    return reports.model_pivot(runs)


@query("model_pivot", f"WITH {_RUNS} SELECT * FROM wide")
def model_pivot(spark, sf):
    return _pivot(spark, sf)


@query("improvement_factor", f"""WITH {_RUNS} SELECT model, round(fine_tuned_legal_pct / nullif(few_shot_legal_pct, 0), 2) AS legal_factor,
  round(fine_tuned_best_pct / nullif(few_shot_best_pct, 0), 2) AS best_factor FROM wide""")
def improvement_factor(spark, sf):
    return reports.improvement_factor(_pivot(spark, sf))


@query("accuracy_curve", """WITH runs AS (
  SELECT concat('model-', doc_id % 3) AS model, CAST(5000 * (1 + doc_id // 3 % 5) AS INT) AS train_size, count(*) AS n,
    avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END) * 100 AS rate FROM labels GROUP BY 1, 2)
SELECT model, train_size, n, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY model ORDER BY train_size), 6) AS gain FROM runs""")
def accuracy_curve(spark, sf):
    rows = fx.table(spark, sf, "labels").select(
        F.expr("concat('model-', doc_id % 3)").alias("model"),
        F.expr("CAST(5000 * (1 + doc_id DIV 3 % 5) AS INT)").alias("train_size"), (F.col("quality") == 1).alias("good"))
    return _rounded(reports.accuracy_curve(rows), "rate", "gain")


_EXPONENTS = [0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0]


@query("saturation_fit", f"""WITH points AS (
  SELECT concat('model-', l_suppkey % 3) AS model, 1000 * (1 + l_partkey % 8) AS size, CAST(count(*) AS DOUBLE) AS w,
    avg(CASE WHEN l_quantity > 12 + 30 / (1 + l_partkey % 8) THEN 1 ELSE 0 END) * 100 AS y FROM lineitem GROUP BY 1, 2),
sums AS (SELECT model, e, sum(w) AS n, sum(w * z) AS sz, sum(w * y) AS sy, sum(w * z * z) AS szz, sum(w * z * y) AS szy, sum(w * y * y) AS syy
  FROM (SELECT *, pow(size, -e) AS z FROM points CROSS JOIN (SELECT unnest({_EXPONENTS}::DOUBLE[]) AS e)) GROUP BY model, e),
fits AS (SELECT *, syy - a * sy - b * szy AS residual FROM (
  SELECT *, (sy - b * sz) / n AS a FROM (SELECT *, (n * szy - sz * sy) / (n * szz - sz * sz) AS b FROM sums))),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY residual) AS place FROM fits)
SELECT model, e AS exponent, round(a, 3) AS ceiling, CASE WHEN b < 0 AND a > 0 THEN round(pow(-b / (a * (1 - 0.95)), 1 / e), 1) END AS saturated_at
FROM best WHERE place = 1""")
def saturation_fit(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.expr("concat('model-', l_suppkey % 3)").alias("model"), F.expr("1000 * (1 + l_partkey % 8)").alias("train_size"),
        F.expr("l_quantity > 12 + 30 / (1 + l_partkey % 8)").alias("good"))
    fit = reports.saturation_fit(rows, _EXPONENTS)
    return fit.select("model", "exponent", F.round("ceiling", 3).alias("ceiling"), F.round("saturated_at", 1).alias("saturated_at"))
