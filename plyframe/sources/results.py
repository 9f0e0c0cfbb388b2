"""Result records as CSV and JSON: writing, reading back, and the viewer's tolerant reading."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.text import is_not_false, is_true, sanitize_model_id, strip
from plyframe.operators.scoring import model_summary
from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written
from plyframe.sources.committed import write_committed

_TEXT_COLUMNS = ["id", "fen", "model_move", "full_reply", "legal", "good", "top_moves"]
_TEXT_SCHEMA = ", ".join(f"{c} STRING" for c in _TEXT_COLUMNS)
_CSV = {
    "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False, "emptyValue": "",
}
_FILE_MODEL = r"evaluate_([^/]+?)(?:\.csv)?(?:/|$)"


def _no_nulls() -> list:
    """CSV text has no nulls: an empty field is empty text."""
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in _TEXT_COLUMNS]


def write_results(scored: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per model, CSV with header. A file is one task when read back, so files are kept
    small. An empty frame leaves one file with the header, in no model's folder."""
    out = scored.select(
        F.concat(F.lit("evaluate_"), sanitize_model_id(F.col("model"))).alias("results"), "id", "fen", "model_move",
        "full_reply", F.initcap(F.col("legal").cast("string")).alias("legal"),
        F.initcap(F.col("good").cast("string")).alias("good"), F.array_join("top_moves", ",").alias("top_moves"),
    )
    out.write.options(header=True, maxRecordsPerFile=rows_per_file, quote='"', escape='"', emptyValue="",
                      ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).partitionBy("results").csv(path)
    if out.sparkSession.read.text(path).isEmpty():
        header = out.sparkSession.createDataFrame([(",".join(_TEXT_COLUMNS),)], "value STRING").coalesce(1)
        header.write.mode("append").text(path)


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Results files by header, every column as text, and the model from the file or folder name."""
    rows = spark.read.schema(_TEXT_SCHEMA).options(header=True, enforceSchema=True, **_CSV).csv(
        paths if isinstance(paths, list) else [paths])
    name = F.regexp_extract(F.col("_metadata.file_path"), _FILE_MODEL, 1)
    return rows.select(name.alias("model"), *_no_nulls())


def read_models(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Results of several models, each under its own path. A path that cannot be read counts as an
    empty data set."""
    parts = []
    for model, path in paths.items():
        try:
            rows = spark.read.schema(_TEXT_SCHEMA).options(header=True, ignoreMissingFiles=True, **_CSV).csv(path)
        except AnalysisException:
            continue
        parts.append(rows.select(F.lit(model).alias("model"), *_no_nulls()))
    if not parts:
        return spark.createDataFrame([], "model STRING, " + _TEXT_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The viewer's reading, by position instead of header: file, pos, fen, model_move, legal,
    full_reply, good.

    Five fields or more: dropped if the fifth says false. Three or four: kept as legal, without
    reply and mark. Fewer: dropped. If the first kept row of a file is the header it goes as well.
    """
    rows = spark.read.schema(_TEXT_SCHEMA + ", _bad STRING").options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", **_CSV).csv(path)
    # A row with fewer or more fields than the schema carries its raw text in _bad.
    commas = F.regexp_replace("_bad", r'"[^"]*"', "")
    width = F.when(F.col("_bad").isNull(), len(_TEXT_COLUMNS)).otherwise(F.size(F.split(commas, ",")))

    def field(name: str):
        return F.coalesce(strip(F.col(name)), F.lit(""))

    rows = rows.select("*", width.alias("_width"), F.col("_metadata.file_path").alias("file"),
                       F.monotonically_increasing_id().alias("pos"))
    full = F.col("_width") >= 5
    kept = rows.where((F.col("_width") >= 3) & (~full | is_not_false(F.col("legal")))).select(
        "file", "pos", field("fen").alias("fen"), field("model_move").alias("model_move"), F.lit(True).alias("legal"),
        F.when(full, field("full_reply")).otherwise("").alias("full_reply"),
        F.when(full, is_true(F.col("good"))).otherwise(False).alias("good"),
    )
    return drop_header(written(kept))


def drop_header(entries: DataFrame) -> DataFrame:
    """Drop the first row of each file if its fen reads "fen"."""
    first = entries.groupBy("file").agg(F.min(F.struct("pos", "fen")).alias("_first"))
    headers = first.where(F.lower("_first.fen") == "fen").select("file", F.col("_first.pos").alias("pos"))
    return entries.join(headers, ["file", "pos"], "left_anti")


def write_evaluations(scored: DataFrame, models: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """evaluate_<model>.csv for every model of `models`, in the order of ids, and summary_<model>.json for those with rows; all
    appear together when everything is written. A model none of whose replies was scored has a file with the header only.
    Rows after the first `rows_per_file` of a model go to evaluate_<model>.1.csv, .2.csv and so on, each with a header."""
    scored = written(scored)  # read by the numbering, which takes it twice, and by the summaries
    name = sanitize_model_id(F.col("model"))
    text = {c: F.col(c).cast("string") for c in _TEXT_COLUMNS} | {c: F.initcap(F.col(c).cast("string")) for c in ("legal", "good")}
    text["top_moves"] = F.array_join("top_moves", ",")
    rows = dense_ordinal(scored, "id", ["model"], out="_ord")
    part = F.floor(F.col("_ord") / rows_per_file).cast("long")
    options = {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    record = F.to_csv(F.struct(*(F.coalesce(v, F.lit("")).alias(c) for c, v in text.items())), options)
    rows = written(rows.select("model", part.alias("part"), (F.col("_ord") + 1).alias("line"), record.alias("value")))
    begun = models.select("model", F.lit(0).cast("long").alias("part")).union(rows.select("model", "part")).distinct()
    headers = begun.select("model", "part", F.lit(0).cast("long").alias("line"), F.lit(",".join(_TEXT_COLUMNS)).alias("value"))
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part").cast("string"))).otherwise("")
    tables = rows.union(headers).select(F.concat(F.lit("evaluate_"), name, suffix, F.lit(".csv")).alias("file"), "line", "value")
    write_committed(tables.union(_as_json(model_summary(scored), F.concat(F.lit("summary_"), name, F.lit(".json")))), folder)


def _as_json(rows: DataFrame, file: Column) -> DataFrame:
    """Lines of one JSON object for each row."""
    return rows.select(file.alias("file"), F.lit(0).cast("long").alias("line"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """training_info.json, as a whole or not at all."""
    write_committed(_as_json(manifest, F.lit("training_info.json")), folder)


def write_summaries(summary: DataFrame, path: str) -> None:
    summary.write.json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "model STRING, test_samples BIGINT, legal_move_rate DOUBLE, top_move_rate DOUBLE, timestamp STRING"
    ).json(path)


def run_manifest(split: DataFrame, base_model: str, epochs: int, batch_size: int, learning_rate: float,
                 training_time_minutes: float | None = None, save_strategy: str | None = None,
                 save_steps: int | None = None) -> DataFrame:
    """One row with sample counts and hyper-parameters; the save columns only if given."""
    out = split.agg(
        F.count_if(F.col("split") == "train").alias("training_samples"),
        F.count_if(F.col("split") == "val").alias("validation_samples"),
    ).select(
        F.lit(base_model).alias("base_model"), "training_samples", "validation_samples", F.lit(epochs).alias("epochs"),
        F.lit(batch_size).alias("batch_size"), F.lit(learning_rate).alias("learning_rate"),
        F.lit(training_time_minutes).cast("double").alias("training_time_minutes"),
    )
    if save_strategy is not None:
        out = out.withColumns({"save_strategy": F.lit(save_strategy), "save_steps": F.lit(save_steps).cast("int")})
    return out
