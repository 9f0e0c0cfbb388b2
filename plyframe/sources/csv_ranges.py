"""Quoted CSV read in parallel, whatever the size of a file.

A quote changes the state of the reader, in or out of quotes, and a doubled quote changes it twice, so the state at any
place follows from the number of quotes before it. Spark reads physical lines by byte ranges; each line is written with the
parity of the quotes of its range before it and, for both states the range may start in, with the line its record begins at.
A range is one row of parity and of last begun records; composing these rows in order of the file gives each range its state.
All ranges are then parsed at once: a line that begins and ends out of quotes is a record, and only the lines of
records with line breaks are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.functions.text import is_not_false, is_true, strip
from plyframe.plans.scratch import written

_MARKED = "file string, block long, line long, value string, before int, after int, begun0 long, begun1 long"
_STATES = (0, 1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of their ranges, with the parity of the range's quotes before and after each and, if the range starts
    out of (0) or in quotes (1), the line of the range in which the record at hand began; null if before the range."""
    now, seen, parity, begun = None, 0, 0, [-1, -1]
    for batch in batches:
        quotes = np.asarray(pc.count_substring(batch["value"], '"').fill_null(0))
        place = list(zip(batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True))
        bounds = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            if start == stop:
                continue
            if place[start] != now:
                now, seen, parity, begun = place[start], 0, 0, [-1, -1]
            line = np.arange(seen, seen + stop - start)
            after = (np.cumsum(quotes[start:stop]) + parity) % 2
            before = np.append(parity, after[:-1])
            for s in _STATES:  # out of quotes where the parity is that of the start
                first = np.maximum.accumulate(np.append(begun[s], np.where(before == s, line, -1)))[1:]
                begun[s] = int(first[-1])
                out[3 + s].append(first)
            for k, c in enumerate((line, before, after)):
                out[k].append(c)
            seen, parity = seen + stop - start, int(after[-1])
        line, before, after, *firsts = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        firsts = [pa.array(f, pa.int64(), mask=f < 0) for f in firsts]
        yield pa.RecordBatch.from_arrays(
            [batch["file"], batch["block"], pa.array(line, pa.int64()), batch["value"], pa.array(before, pa.int32()), pa.array(after, pa.int32()), *firsts],
            ["file", "block", "line", "value", "before", "after", "begun0", "begun1"])


def _fields(record: Column) -> Column:
    """The fields of a record's text: quotes dropped, doubled ones kept once, commas and carriage returns kept in quotes.

    Between quotes lie alternately outer and inner parts, and an empty outer part between two inner ones is a doubled
    quote. Outer commas become a noncharacter to cut at; should the text hold it, it is spelled otherwise meanwhile.
    """
    cut, spell = "￿", "￾"
    parts = F.split(F.replace(F.replace(record, F.lit(spell), F.lit(spell + "0")), F.lit(cut), F.lit(spell + "1")), '"')
    last = F.size(parts) - 1

    def part(p: Column, i: Column) -> Column:
        outer = F.translate(p, ",\r", cut)
        return F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), '"').otherwise(outer)

    fields = F.split(F.array_join(F.transform(parts, part), ""), cut)
    return F.transform(fields, lambda f: F.replace(F.replace(f, F.lit(spell + "1"), F.lit(cut)), F.lit(spell + "0"), F.lit(spell)))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, line (the place of a record's first line), fields: the records of quoted CSV files.

    Records end at line feeds out of quotes; carriage returns out of quotes are ignored, quotes may begin anywhere in a
    field. A last record without a line feed counts; a quote that is never closed takes the rest of its file, less a last
    line feed. An empty line is a record of one empty field.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = written(text.mapInArrow(_marked, _MARKED))
    ranges = lines.groupBy("file", "block").agg(
        F.max_by("after", "line").alias("parity"), F.max("begun0").alias("begun0"), F.max("begun1").alias("begun1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("state", F.coalesce(F.sum("parity").over(earlier) % 2, F.lit(0)).cast("int"))
    begun = F.when(F.col("state") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    open_ = F.last(F.when(begun.isNotNull(), F.struct("block", begun.alias("line"))), ignorenulls=True).over(earlier)
    ranges = ranges.select("file", "block", "state", open_.alias("open"))
    lines = lines.join(ranges, ["file", "block"])
    own = F.when(F.col("state") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    lines = lines.select(
        "file", "block", "line", "value", F.col("before").bitwiseXOR(F.col("state")).alias("before"),
        F.col("after").bitwiseXOR(F.col("state")).alias("after"),
        F.when(own.isNotNull(), F.struct("block", own.alias("line"))).otherwise(F.col("open")).alias("begun"))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    parts = lines.where(~alone).groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    joined = parts.select("file", "begun.block", "begun.line", F.array_join("parts.value", "\n").alias("value"))
    records = lines.where(alone).select("file", "block", "line", "value").union(joined)
    return records.select("file", "block", "line", _fields(F.col("value")).alias("fields"))


def _first(records: DataFrame) -> DataFrame:
    return records.groupBy("file").agg(F.min(F.struct("block", "line", "fields")).alias("first")).select("file", "first.*")


def by_header(records: DataFrame, columns: list[str]) -> DataFrame:
    """file and `columns`, as text, from records whose file names its columns in its first record. Files may order them
    differently; a column that a file or a record lacks is empty, an empty line is no record."""
    heads = _first(records).select("file", F.col("fields").alias("names"), F.col("block").alias("b0"), F.col("line").alias("l0"))
    rows = records.join(heads, "file").where(~((F.col("block") == F.col("b0")) & (F.col("line") == F.col("l0"))))
    rows = rows.where((F.size("fields") > 1) | (F.col("fields")[0] != ""))

    def value(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.coalesce(F.when(at > 0, F.get("fields", at - 1)), F.lit("")).alias(name)

    return rows.select("file", *map(value, columns))


def entries(records: DataFrame) -> DataFrame:
    """The viewer's reading, by position: file, block, line, fen, model_move, legal, full_reply, good.

    Five fields or more: dropped if the fifth says false. Three or four: kept as legal, without reply and mark. Fewer:
    dropped. If the first kept record of a file is the header it goes as well.
    """
    width = F.size("fields")
    full = width >= 5

    def field(at: int) -> Column:
        return F.coalesce(strip(F.get("fields", F.lit(at))), F.lit(""))

    kept = records.where((width >= 3) & (~full | is_not_false(field(4)))).select(
        "file", "block", "line", field(1).alias("fen"), field(2).alias("model_move"), F.lit(True).alias("legal"),
        F.when(full, field(3)).otherwise("").alias("full_reply"), F.when(full, is_true(field(5))).otherwise(False).alias("good"))
    kept = written(kept)
    first = kept.groupBy("file").agg(F.min(F.struct("block", "line", "fen")).alias("first"))
    heads = first.where(F.lower("first.fen") == "fen").select("file", "first.block", "first.line")
    return kept.join(heads, ["file", "block", "line"], "left_anti")
