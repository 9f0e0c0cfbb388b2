"""Engine evaluations as JSON lines, compressed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
_BLANK = r"[\x20\t\r\n]*"
_STRING = r'"(?:[^"\\]|\\.)*+"'  # possessive: nothing is tried again


def _is_object(text: Column) -> Column:
    """Whether the text, valid UTF-8, begins as an object and ends with it: no brace but the last closes the first."""
    begun = F.is_valid_utf8(text) & F.rlike(text, F.lit(rf"^{_BLANK}\{{")) & F.rlike(text, F.lit(rf"\}}{_BLANK}\z"))
    # Without strings and all else but braces, what is left has to be closed by its last character.
    braces = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^{}]+", "")
    depth = F.aggregate(F.split(braces, ""), F.struct(F.lit(0).alias("open"), F.lit(0).alias("ends")), lambda s, c: F.struct(
        (s["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("open"),
        (s["ends"] + F.when((c == "}") & (s["open"] == 1), 1).otherwise(0)).alias("ends")))
    return F.coalesce(begun, F.lit(False)) & F.coalesce((depth["open"] == 0) & (depth["ends"] == 1), F.lit(False))


def decode_evals(lines: DataFrame, text: str = "value") -> DataFrame:
    """Documents (fen, evals) from lines of JSON, with the other columns of `lines`.

    A line is left out only for its syntax, whatever columns are read later. Numbers that are none become null; a null
    list of variations, which no reader of the format accepts, makes the document's evals null.
    """
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(_is_object(F.col(text))).select(
        *keep, F.from_json(text, "fen STRING, evals STRING, _bad STRING", _BAD).alias("_doc"))
    rows = rows.where(F.col("_doc").isNotNull() & F.col("_doc._bad").isNull())
    given = F.when(~F.rlike("_doc.evals", F.lit(r'"pvs"\s*:\s*null')), F.col("_doc.evals"))
    evals = F.from_json(given, "ARRAY<STRUCT<knodes: STRING, depth: STRING, pvs: ARRAY<STRUCT<cp: STRING, mate: STRING, line: STRING>>>>")
    typed = F.transform(evals, lambda e: F.struct(
        e["knodes"].try_cast("bigint").alias("knodes"), e["depth"].try_cast("int").alias("depth"),
        F.transform(e["pvs"], lambda pv: F.struct(
            pv["cp"].try_cast("int").alias("cp"), pv["mate"].try_cast("int").alias("mate"), pv["line"].alias("line"))).alias("pvs")))
    return rows.select(*keep, F.col("_doc.fen").alias("fen"), typed.alias("evals"))


def in_order(lines: DataFrame, file: str, line: str) -> DataFrame:
    """Replace `file` and `line`, a line's number in its file, by `at`: one text key in order of files and lines."""
    at = F.concat(F.col(file), F.lit("#"), F.lpad(F.col(line).cast("string"), 19, "0"))
    return lines.select(*[c for c in lines.columns if c not in (file, line)], at.alias("at"))


def read_evals(spark: SparkSession, path: str | list[str], keep_order: bool = False) -> DataFrame:
    """Documents of JSON-lines files, malformed lines left out. `keep_order` adds `at`, the key of the line's place.

    Spark's reader takes a last line without a newline for a line. A .zst file is one task, and its window may be up to
    128 MiB; for longer windows, and for dropping unfinished lines, see `zstd_lines`. Decode once and keep the result as
    Parquet.
    """
    lines = spark.read.text(path)
    if keep_order:
        place = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
        lines = lines.select("value", F.concat(F.col("_metadata.file_path"), F.lit("#"), place).alias("_file"),
                             F.monotonically_increasing_id().alias("_line"))
        lines = in_order(lines, "_file", "_line")
    return decode_evals(lines)


def decode_json(rows: DataFrame, text: str, schema: str, out: str = "obj") -> DataFrame:
    """Parse column `text`; rows that are not a JSON object are left out."""
    parsed = F.from_json(F.col(text), f"{schema}, _bad STRING", _BAD)
    return (
        rows.where(_is_object(F.col(text))).withColumn(out, parsed)
        .where(F.col(out).isNotNull() & F.col(f"{out}._bad").isNull())
        .withColumn(out, F.col(out).dropFields("_bad"))
    )


def reject_counts(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """How many rows a tolerant decode keeps and rejects, in one pass."""
    marked = rows.select(
        _is_object(F.col(text)).alias("_object"), F.from_json(F.col(text), f"{schema}, _bad STRING", _BAD).alias("_o"))
    kept = F.count_if(F.col("_object") & F.col("_o").isNotNull() & F.col("_o._bad").isNull())
    return marked.agg(F.count("*").alias("total"), kept.alias("kept")).withColumn(
        "rejected", F.col("total") - F.col("kept"))
