"""Queries over result files: each writes rows of the driver tables to a fresh folder and reads
them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.operators import scoring
from plyframe.plans.scratch import scratch_folder
from plyframe.queries import fixtures as fx
from plyframe.queries.registry import query
from plyframe.queries.scores import scored
from plyframe.sources import csv_ranges, results


@query("results_csv_roundtrip", f"""WITH {fx.SQL_SCORED} SELECT replace(replace(model, '/', '_'), ':', '_') AS model,
  CAST(id AS VARCHAR) AS id, fen, model_move, full_reply, CASE WHEN legal THEN 'True' ELSE 'False' END AS legal,
  CASE WHEN good THEN 'True' ELSE 'False' END AS good, top_moves FROM fx_scored""")
def results_csv_roundtrip(spark, sf):
    path = scratch_folder(spark)
    results.write_results(scored(spark, sf), path)
    return results.read_results(spark, path)


@query("summary_json_roundtrip", f"""WITH {fx.SQL_SCORED} SELECT model, count(*) AS test_samples,
  round(avg(CAST(legal AS INT)) * 100, 6) AS legal_move_rate, round(avg(CAST(good AS INT)) * 100, 6) AS top_move_rate
FROM fx_scored GROUP BY model""")
def summary_json_roundtrip(spark, sf):
    path = scratch_folder(spark)
    results.write_summaries(scoring.model_summary(scored(spark, sf)), path)
    return results.read_summaries(spark, path).select(
        "model", "test_samples", F.round("legal_move_rate", 6).alias("legal_move_rate"),
        F.round("top_move_rate", 6).alias("top_move_rate"))


def _write_csv(df, path):
    df.write.options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False).csv(path)


def _as_results(df):
    """Bring id, model, legal, good into the seven columns of a results file."""
    return df.select("model", "id", F.lit("8/8/8/8/8/8/8/8 w - -").alias("fen"), F.lit("e4").alias("model_move"),
                     F.lit("Best Move: e4").alias("full_reply"), "legal", "good", F.lit("e4,d4").alias("top_moves"))


@query("results_csv_scan", f"WITH {fx.SQL_RESULTS} SELECT CAST(id AS VARCHAR) AS id, legal, good FROM fx_results")
def results_csv_scan(spark, sf):
    path = scratch_folder(spark)
    _write_csv(_as_results(fx.results(spark, sf)).drop("model"), path)
    return results.read_results(spark, path).select("id", "legal", "good")


@query("csv_multiline_scan", """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS fen,
  concat('said "', text, '", then', chr(10), 'more') AS full_reply FROM documents""")
def csv_multiline_scan(spark, sf):
    path = scratch_folder(spark)
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("fen"), F.lit("e4").alias("model_move"),
        F.expr("concat('said \"', text, '\", then', char(10), 'more')").alias("full_reply"),
        F.lit("True").alias("legal"), F.lit("True").alias("good"), F.lit("").alias("top_moves"))
    _write_csv(docs, path)
    return results.read_results(spark, path).select("id", "fen", "full_reply")


@query("csv_parallel_scan", """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS fen,
  concat('said "', text, '", then', chr(10), 'more') AS full_reply FROM documents""")
def csv_parallel_scan(spark, sf):
    path = scratch_folder(spark)
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("fen"), F.lit("e4").alias("model_move"),
        F.expr("concat('said \"', text, '\", then', char(10), 'more')").alias("full_reply"))
    _write_csv(docs, path)
    return csv_ranges.by_header(csv_ranges.read_records(spark, path), ["id", "fen", "full_reply"]).drop("file")


@query("model_file_union", f"""WITH {fx.SQL_RESULTS} SELECT model, CAST(id AS VARCHAR) AS id, legal, good FROM fx_results
WHERE model IN ('gpt20b', 'mistral7b')""")
def model_file_union(spark, sf):
    path = scratch_folder(spark)
    rows = _as_results(fx.results(spark, sf))
    rows.write.partitionBy("model").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                            ignoreTrailingWhiteSpace=False).csv(path)
    paths = {m: f"{path}/model={m}" for m in ("gpt20b", "mistral7b", "not-there")}
    return results.read_models(spark, paths).select("model", "id", "legal", "good")


# Lines of six widths, some with quoted commas and quotes; `false` in the fifth field drops a row.
_LINES = '''CASE doc_id % 7
  WHEN 0 THEN concat(doc_id, ', fen', doc_id, ' ,e4,"a, ""b""",True,True,"e4,d4"')
  WHEN 1 THEN concat(doc_id, ',fen', doc_id, ',e4,reply, FALSE ,True,x')
  WHEN 2 THEN concat(doc_id, ',fen', doc_id, ',"e,4",reply,yes,TRUE')
  WHEN 3 THEN concat(doc_id, ',fen', doc_id, ',e4,reply,true')
  WHEN 4 THEN concat(doc_id, ',fen', doc_id, ',e4,reply')
  WHEN 5 THEN concat(doc_id, ',fen', doc_id, ',e4')
  ELSE concat(doc_id, ',fen', doc_id) END'''
_KEPT = """SELECT concat('fen', doc_id) AS fen, CASE doc_id % 7 WHEN 2 THEN 'e,4' ELSE 'e4' END AS model_move, true AS legal,
  CASE doc_id % 7 WHEN 0 THEN 'a, "b"' WHEN 2 THEN 'reply' WHEN 3 THEN 'reply' ELSE '' END AS full_reply,
  doc_id % 7 IN (0, 2) AS good
FROM documents WHERE doc_id % 7 NOT IN (1, 6)"""


@query("csv_row_rules", _KEPT)
def csv_row_rules(spark, sf):
    path = scratch_folder(spark)
    fx.table(spark, sf, "documents").select(F.expr(_LINES)).write.text(path)
    return results.read_entries(spark, path).select("fen", "model_move", "legal", "full_reply", "good")


@query("csv_header_drop", _KEPT)
def csv_header_drop(spark, sf):
    # Every file starts with a header line: the text writer turns a newline in a value into a line.
    path = scratch_folder(spark)
    rows = fx.table(spark, sf, "documents").select("doc_id", F.expr(_LINES).alias("line"))
    rows = rows.repartition(4, "doc_id").sortWithinPartitions("doc_id").select(
        "line", F.expr("monotonically_increasing_id() % 8589934592 = 0").alias("is_first"))
    header = "id,FEN,model_move,full_reply,legal,good,top_moves"
    rows.select(F.when(F.col("is_first"), F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line"))).write.text(path)
    return results.read_entries(spark, path).select("fen", "model_move", "legal", "full_reply", "good")


@query("csv_parallel_entries", _KEPT)
def csv_parallel_entries(spark, sf):
    path = scratch_folder(spark)
    fx.table(spark, sf, "documents").select(F.expr(_LINES)).write.text(path)
    return csv_ranges.entries(csv_ranges.read_records(spark, path)).select("fen", "model_move", "legal", "full_reply", "good")
