"""Queries over documents, samples, splits and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.functions import fen as fenf
from plyframe.functions import text as t
from plyframe.operators import samples as smp
from plyframe.operators import splits
from plyframe.operators.scoring import evaluate_replies
from plyframe.plans import ordinals, zones
from plyframe.plans.scratch import scratch_folder, written
from plyframe.queries import fixtures as fx
from plyframe.queries.registry import query
from plyframe.sources import evals, results, zstd_frames
from plyframe.sources.zstd_lines import read_zstd_lines, write_zstd_lines

TRAIN, VAL, TEST = 5000, 500, 500


def _samples(spark, sf):
    return smp.valid_samples(fx.documents(spark, sf), "pos_id")


def _joined(df):
    return df.withColumn("top_moves", F.array_join("top_moves", ","))


@query("scan_eval_jsonl", f"""WITH {fx.SQL_PVS}
SELECT pos_id * 10 + eval_idx AS knodes, fen, pv_idx, cp, mate, line FROM fx_pvs""")
def scan_eval_jsonl(spark, sf):
    path = scratch_folder(spark)
    fx.documents(spark, sf).select("fen", "evals").write.option("compression", "gzip").json(path)
    docs = evals.read_evals(spark, path)
    rows = docs.select("fen", F.explode("evals").alias("e")).select("fen", "e.knodes", F.posexplode("e.pvs").alias("pv_idx", "pv"))
    return rows.select("knodes", "fen", "pv_idx", "pv.cp", "pv.mate", "pv.line")


_FX_JSON = """fx_json AS (
  SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{bad' WHEN 1 THEN '' WHEN 2 THEN '[1]' ELSE props END AS raw FROM events)"""


def _json_rows(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", F.expr("CASE event_id % 10 WHEN 0 THEN '{bad' WHEN 1 THEN '' WHEN 2 THEN '[1]' ELSE props END").alias("raw"))


@query("json_decode_skip_bad", f"""WITH {_FX_JSON}
SELECT event_id, CAST(regexp_extract(raw, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM fx_json
WHERE raw LIKE '{{%' AND raw LIKE '%}}'""")
def json_decode_skip_bad(spark, sf):
    return evals.decode_json(_json_rows(spark, sf), "raw", "k BIGINT").select("event_id", "obj.k")


@query("json_reject_counts", f"""WITH {_FX_JSON}
SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 10 > 2) AS kept,
  count(*) FILTER (WHERE event_id % 10 <= 2) AS rejected FROM fx_json""")
def json_reject_counts(spark, sf):
    return evals.reject_counts(_json_rows(spark, sf), "raw", "k BIGINT")


@query("take_first_valid", f"""WITH {fx.SQL_TOP}
SELECT pos_id, fen, best_move, top_moves FROM fx_samples ORDER BY pos_id LIMIT {TRAIN}""")
def take_first_valid(spark, sf):
    return _joined(splits.take_first_valid(fx.documents(spark, sf), TRAIN, "pos_id").drop("ord"))


@query("eval_sample_source", f"""WITH {fx.SQL_TOP}
SELECT row_number() OVER (ORDER BY pos_id) - 1 AS id, pos_id, fen, best_move, top_moves
FROM fx_samples ORDER BY pos_id LIMIT {TEST}""")
def eval_sample_source(spark, sf):
    first = splits.take_first_valid(fx.documents(spark, sf), TEST, "pos_id")
    return _joined(splits.eval_samples(first, TEST, "pos_id"))


@query("flatten_pvs", f"WITH {fx.SQL_PVS} SELECT pos_id, eval_idx, pv_idx, cp, mate, line FROM fx_pvs")
def flatten_pvs(spark, sf):
    return smp.flatten_pvs(fx.documents(spark, sf), "pos_id")


@query("pv_first_move", f"""WITH {fx.SQL_PVS}
SELECT pos_id, eval_idx, pv_idx, split_part(ltrim(line), ' ', 1) AS first_move, line = '   ' AS rejects_document
FROM fx_pvs WHERE line <> ''""")
def pv_first_move(spark, sf):
    pvs = smp.flatten_pvs(fx.documents(spark, sf), "pos_id").where("line <> ''")
    return pvs.select("pos_id", "eval_idx", "pv_idx", smp.first_word(F.col("line")).alias("first_move"),
                      F.rlike("line", F.lit(r"^\s+$")).alias("rejects_document"))


@query("uci_decode", f"""WITH {fx.SQL_PVS}
SELECT pos_id, eval_idx, pv_idx, uci,
  ascii(uci) - 97 + 8 * (ascii(substr(uci, 2, 1)) - 49) AS frm,
  ascii(substr(uci, 3, 1)) - 97 + 8 * (ascii(substr(uci, 4, 1)) - 49) AS "to", substr(uci, 5) AS promo
FROM fx_pvs WHERE line LIKE '% e7e5%' AND regexp_full_match(uci, '[a-h][1-8][a-h][1-8][nbrq]?')""")
def uci_decode(spark, sf):
    pvs = smp.flatten_pvs(fx.documents(spark, sf), "pos_id").where("line <> ''")
    rows = pvs.select("pos_id", "eval_idx", "pv_idx", smp.first_word(F.col("line")).alias("uci"))
    return rows.withColumn("m", fenf.uci_parts(F.col("uci"))).where("m IS NOT NULL").select(
        "pos_id", "eval_idx", "pv_idx", "uci", "m.frm", "m.to", "m.promo")


@query("legal_candidates", f"""WITH {fx.SQL_PVS}
SELECT DISTINCT pos_id, uci AS head, san FROM fx_pvs
WHERE san IS NOT NULL AND line LIKE '% e7e5%' AND pos_id NOT IN (SELECT pos_id FROM fx_pvs WHERE line = '   ')""")
def legal_candidates(spark, sf):
    return smp.legal_candidates(fx.documents(spark, sf), "pos_id").select("pos_id", "head", "san")


@query("best_move", f"WITH {fx.SQL_TOP} SELECT pos_id, fen, best_move FROM fx_samples")
def best_move(spark, sf):
    return _samples(spark, sf).select("pos_id", "fen", "best_move")


@query("top_moves", f"WITH {fx.SQL_TOP} SELECT pos_id, top_moves FROM fx_samples")
def top_moves(spark, sf):
    return _joined(_samples(spark, sf).select("pos_id", "top_moves"))


@query("top_moves_csv", f"WITH {fx.SQL_TOP} SELECT pos_id, top_moves, len(string_split(top_moves, ',')) AS n FROM fx_samples")
def top_moves_csv(spark, sf):
    text = _joined(_samples(spark, sf).select("pos_id", "top_moves"))
    return text.withColumn("n", F.size(F.split("top_moves", ",")).cast("bigint"))


@query("valid_samples", f"WITH {fx.SQL_TOP} SELECT pos_id, fen, best_move, top_moves FROM fx_samples")
def valid_samples(spark, sf):
    return _joined(_samples(spark, sf))


_SPLIT = f"""WITH {fx.SQL_TOP}, numbered AS (
  SELECT pos_id, row_number() OVER (ORDER BY pos_id) - 1 AS ord FROM fx_samples),
split AS (SELECT pos_id, ord, CASE WHEN ord < {TRAIN} THEN 'train' WHEN ord < {TRAIN + VAL} THEN 'val' ELSE 'test' END AS split
  FROM numbered WHERE ord < {TRAIN + VAL + TEST})"""


def _split(spark, sf):
    first = splits.take_first_valid(fx.documents(spark, sf), TRAIN + VAL + TEST, "pos_id")
    return splits.sequential_split(first, TRAIN, VAL, TEST, "pos_id")


@query("sequential_split", f"{_SPLIT} SELECT pos_id, ord, split FROM split")
def sequential_split(spark, sf):
    return _split(spark, sf).select("pos_id", "ord", "split")


@query("split_counts", f"""{_SPLIT} SELECT s.split, count(pos_id) AS n
FROM (VALUES ('train'), ('val'), ('test')) AS s(split) LEFT JOIN split ON split.split = s.split GROUP BY s.split""")
def split_counts(spark, sf):
    return splits.split_counts(_split(spark, sf))


@query("run_manifest", f"""{_SPLIT} SELECT 'org/model-a' AS base_model,
  count(*) FILTER (WHERE split = 'train') AS training_samples, count(*) FILTER (WHERE split = 'val') AS validation_samples,
  2 AS epochs, 8 AS batch_size, CAST(2e-5 AS DOUBLE) AS learning_rate, CAST(1.5 AS DOUBLE) AS training_time_minutes,
  'steps' AS save_strategy, 500 AS save_steps FROM split""")
def run_manifest(spark, sf):
    path = scratch_folder(spark)
    manifest = results.run_manifest(_split(spark, sf), "org/model-a", 2, 8, 2e-5, 1.5, "steps", 500)
    manifest.write.json(path)
    return spark.read.schema(manifest.schema).json(path)


@query("eval_ids", f"""WITH {fx.SQL_TOP}{fx.SQL_REPLIES_BODY}, numbered AS (
  SELECT pos_id, row_number() OVER (ORDER BY pos_id) - 1 AS id FROM fx_samples)
SELECT n.id, n.pos_id, r.model FROM numbered n JOIN fx_replies r ON r.id = n.pos_id
WHERE r.shape <> 4""")
def eval_ids(spark, sf):
    numbered = ordinals.dense_ordinal(written(_samples(spark, sf).select("pos_id")), "pos_id", out="id")
    answered = fx.replies(spark, sf).where("full_reply <> 'I am not sure.'").select("model", F.col("id").alias("pos_id"))
    return numbered.join(answered, "pos_id").select("id", "pos_id", "model")


_FILE = 4096  # keys of a corpus file
_CORPUS = f"""WITH {fx.SQL_TOP}, numbered AS (
  SELECT fen, best_move, top_moves, row_number() OVER (ORDER BY pos_id) - 1 AS ord FROM fx_samples)
SELECT ord, CASE WHEN ord < {TRAIN} THEN 'train' WHEN ord < {TRAIN + VAL} THEN 'val' ELSE 'test' END AS split,
  fen, best_move, top_moves FROM numbered WHERE ord < {TRAIN + VAL + TEST}"""


def _write_corpus(spark, sf, frame_bytes=None):
    """Compressed files of ranges of keys, so that they grow in number with the table, with misfit numbers, lines that are no
    JSON, and an unfinished last line each."""
    docs = fx.documents(spark, sf).select("pos_id", "fen", "evals")
    text = F.to_json(F.struct("fen", "evals"))
    text = F.when(F.col("pos_id") % 4 == 0, F.regexp_replace(text, '"knodes":[0-9]+', '"knodes":"x"')).otherwise(text)
    file = F.concat(F.lit("part"), F.lpad(F.floor(F.col("pos_id") / _FILE).cast("string"), 12, "0"), F.lit(".jsonl")).alias("file")
    lines = docs.select(file, (2 * F.col("pos_id") + 1).alias("line"), text.alias("value"))
    legal = '{"fen": "8/8/8/8/8/8/4K2k/R7 w - -", "evals": [{"pvs": [{"line": "a1a2"}]}]}'
    kinds = ("{bad", legal.replace('"', "'"), legal + " trailing", legal + legal)
    bad = docs.where("pos_id % 5 = 0").select(file, (2 * F.col("pos_id")).alias("line"), F.element_at(
        F.array(*map(F.lit, kinds)), (F.col("pos_id") % 4 + 1).cast("int")).alias("value"))
    last = docs.select(file).distinct().select("file", F.lit(2**62).alias("line"), F.lit(legal).alias("value"))
    folder = scratch_folder(spark)
    write_zstd_lines(lines.union(bad).union(last), folder, finished=False, frame_bytes=frame_bytes)
    return folder


@query("corpus_to_split", _CORPUS)
def corpus_to_split(spark, sf):
    lines = read_zstd_lines(spark, _write_corpus(spark, sf))
    corpus = written(evals.decode_evals(evals.in_order(lines, "file", "line_no")))
    first = splits.take_first_valid(corpus, TRAIN + VAL + TEST, "at")
    return _joined(splits.sequential_split(first, TRAIN, VAL, TEST, "at")).select("ord", "split", "fen", "best_move", "top_moves")


@query("corpus_frames_to_split", _CORPUS)
def corpus_frames_to_split(spark, sf):
    """The corpus in many frames, read by frames and kept in zones, which give the split its rows."""
    index = written(zstd_frames.frame_index(spark, _write_corpus(spark, sf, frame_bytes=1 << 18)))
    corpus = evals.decode_evals(evals.in_order(zstd_frames.read_frames(spark, index), "file", "line_no"))
    folder = scratch_folder(spark)
    zones.append(written(corpus), folder, "at", lambda d: smp.valid_samples(d, "at"), zone_rows=4096)
    first = zones.numbered(spark, folder, "at", below=TRAIN + VAL + TEST)
    return _joined(splits.sequential_split(first, TRAIN, VAL, TEST, "at")).select("ord", "split", "fen", "best_move", "top_moves")


@query("split_after_append", f"""WITH {fx.SQL_TOP}, numbered AS (
  SELECT pos_id, row_number() OVER (ORDER BY pos_id % 3 = 0, pos_id) - 1 AS ord FROM fx_samples)
SELECT pos_id, ord, CASE WHEN ord < {TRAIN} THEN 'train' WHEN ord < {TRAIN + VAL} THEN 'val' ELSE 'test' END AS split
FROM numbered WHERE ord < {TRAIN + VAL + TEST}""")
def split_after_append(spark, sf):
    """A corpus that grows by a second table: numbers go on where they ended, those given stay."""
    docs, folder = fx.documents(spark, sf), scratch_folder(spark)
    for part in (docs.where("pos_id % 3 <> 0"), docs.where("pos_id % 3 = 0")):
        zones.append(part, folder, "pos_id", lambda d: smp.valid_samples(d, "pos_id"), zone_rows=4096)
    first = zones.numbered(spark, folder, "pos_id", below=TRAIN + VAL + TEST)
    return splits.sequential_split(first, TRAIN, VAL, TEST, "pos_id").select("pos_id", "ord", "split")


@query("results_csv_empty", "SELECT 'id,fen,model_move,full_reply,legal,good,top_moves' AS value FROM region WHERE r_regionkey = 0")
def results_csv_empty(spark, sf):
    """What is left when no reply could be scored, as all samples are malformed: one file with the header."""
    path = scratch_folder(spark)
    failing = fx.positions(spark, sf).select(F.col("pos_id").alias("id"), F.concat(F.lit("9"), "fen").alias("fen"), F.array(F.lit("e4")).alias("top_moves"))
    results.write_results(evaluate_replies(failing, fx.replies(spark, sf)), path)
    return spark.read.text(path).select("value")


@query("bool_coercion", f"""WITH {fx.SQL_RESULTS} SELECT id, lower(trim(legal)) = 'true' AS report_legal,
  lower(trim(legal)) <> 'false' AS viewer_legal, lower(trim(good)) = 'true' AS viewer_good FROM fx_results""")
def bool_coercion(spark, sf):
    return fx.results(spark, sf).select(
        "id", t.is_true(F.col("legal")).alias("report_legal"), t.is_not_false(F.col("legal")).alias("viewer_legal"),
        t.is_true(F.col("good")).alias("viewer_good"))


@query("side_to_move", f"""WITH {fx.SQL_POSITIONS}
SELECT pos_id, CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END AS side FROM fx_positions""")
def side_to_move(spark, sf):
    return fx.positions(spark, sf).select("pos_id", fenf.side_to_move(F.col("fen")).alias("side"))


@query("sanitize_model_id", f"""WITH {fx.SQL_REPLIES} SELECT id, replace(replace(model, '/', '_'), ':', '_') AS name,
  concat('finetuned_', replace(replace(model, '/', '_'), ':', '_')) AS tuned_name FROM fx_replies""")
def sanitize_model_id(spark, sf):
    name = t.sanitize_model_id(F.col("model"))
    return fx.replies(spark, sf).select("id", name.alias("name"), F.concat(F.lit("finetuned_"), name).alias("tuned_name"))
