"""Lines of zstd files read by as many tasks as their frames allow.

A file of several frames can be decoded from the start of any of them. An index keeps, for each frame, its place in the file
and how many line feeds it holds, so line numbers follow from sums of the frames before it. Frames are dealt to tasks;
lines that lie within a frame leave their task as they are, and only what a frame begins or ends with is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.plans.scratch import written
from plyframe.sources.zstd_lines import MAX_WINDOW

# --- fixed values of the file format -------------------------------------------------------
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50  # the last four bits of a skippable frame's number are free
LONGEST_HEADER = 18
# ------------------------------------------------------------------------------------------
_CHUNK = 1 << 20
_BATCH = 1 << 22
PER_TASK = 1 << 22  # compressed bytes; the text, and what is made of it, is many times that
_PLACES = "file string, frame long, offset long, size long"
_PIECES = "file string, line long, part long, value binary, ended boolean"


def _open(uri: str):
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
    return filesystem.open_input_file(path)


def _frames(file) -> Iterator[tuple[int, int]]:
    """Offset and size of each frame that holds data, from the headers of frames and blocks alone."""
    import zstandard

    at, end = 0, file.size()

    def read(start: int, n: int) -> bytes:
        file.seek(start)
        return file.read(n)

    while at < end:
        head = read(at, LONGEST_HEADER)
        magic = int.from_bytes(head[:4], "little")
        if magic & ~15 == SKIPPABLE:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != FRAME:
            raise ValueError(f"no zstd frame at byte {at}")
        start, at, last = at, at + zstandard.frame_header_size(head), False
        while not last:
            block = int.from_bytes(read(at, 3), "little")
            last, repeated = block & 1, block >> 1 & 3 == 1
            at += 3 + (1 if repeated else block >> 3)
        at += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield start, at - start


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch["file"].to_pylist():
            with _open(uri) as file:
                places = list(_frames(file))
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(uri, pa.string()), n), pa.array(range(n), pa.int64()), pa.array([o for o, _ in places], pa.int64()),
                 pa.array([s for _, s in places], pa.int64())], ["file", "frame", "offset", "size"])


def _decoded(uri: str, offset: int, size: int, max_window: int) -> Iterator[bytes]:
    import zstandard

    with _open(uri) as file:
        file.seek(offset)
        decoder = zstandard.ZstdDecompressor(max_window_size=max_window).decompressobj()
        while size > 0 and (chunk := file.read(min(size, _CHUNK))):
            size -= len(chunk)
            yield decoder.decompress(chunk)


def _tasks(places: DataFrame, per_task: int) -> int:
    """How many tasks take `per_task` compressed bytes each, but no fewer than there are cores, while frames suffice. Frames
    are few rows that stand for much work, so the number is not left to the size of the rows."""
    frames, total = places.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, -(-total // per_task), min(frames, places.sparkSession.sparkContext.defaultParallelism))


def frame_index(spark: SparkSession, path: str, max_window: int = MAX_WINDOW) -> DataFrame:
    """file, frame, offset, size, feeds (line feeds in the frame), first (those in the frames before it) of the *.zst files
    of a folder, or of one file. Write it beside the corpus: the files are decoded once for it, each frame by itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select(F.col("path").alias("file"))
    places = written(files.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(_placed, _PLACES))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feeds = [sum(c.count(b"\n") for c in _decoded(*row, max_window))
                     for row in zip(*(batch[c].to_pylist() for c in ("file", "offset", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(feeds, pa.int64())], [*batch.schema.names, "feeds"])

    counts = places.repartitionByRange(_tasks(places, PER_TASK), "file", "frame").mapInArrow(counted, f"{_PLACES}, feeds long")
    before = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)  # a row for each frame
    return counts.withColumn("first", F.coalesce(F.sum("feeds").over(before), F.lit(0)))


def read_frames(spark: SparkSession, index: DataFrame, per_task: int = PER_TASK, max_window: int = MAX_WINDOW) -> DataFrame:
    """file, line_no, value as `read_zstd_lines` gives them, from the frames of an index: a last line counts only if it is
    ended, and the value of a line that is not UTF-8 is null.

    `per_task` is how many compressed bytes a task takes at most, about, in whole frames; a line is one value, whatever frames it spans.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(file, frame, found):
            line, value, ended = zip(*found, strict=True)
            n = len(line)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), n), pa.array(line, pa.int64()), pa.repeat(pa.scalar(frame, pa.int64()), n),
                                               pa.array(value, pa.binary()), pa.array(ended, pa.bool_())], ["file", "line", "part", "value", "ended"])

        for batch in batches:
            for file, frame, offset, size, first in zip(*(batch[c].to_pylist() for c in ("file", "frame", "offset", "size", "first")), strict=True):
                found, held, rest, line = [], 0, [], first
                for chunk in _decoded(file, offset, size, max_window):
                    *whole, last = chunk.split(b"\n")
                    for text in whole:
                        found.append((line, b"".join([*rest, text]), True))
                        held, line, rest = held + len(found[-1][1]), line + 1, []
                    rest.append(last)
                    if held > _BATCH:
                        yield rows(file, frame, found)
                        found, held = [], 0
                found.append((line, b"".join(rest), False))
                yield rows(file, frame, found)

    dealt = index.select("file", "frame", "offset", "size", "first").repartitionByRange(_tasks(index, per_task), "file", "frame")
    begins = index.select("file", F.col("frame").alias("part"), F.col("first").alias("begins"))
    cut = dealt.mapInArrow(pieces, _PIECES).join(begins, ["file", "part"])
    cut = written(cut.withColumn("whole", F.col("ended") & (F.col("line") > F.col("begins"))))
    edges = cut.where(~F.col("whole")).groupBy("file", "line").agg(
        F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts"), F.max("ended").alias("ended")).where("ended")
    joined = edges.select("file", "line", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["value"])).alias("value"))
    lines = cut.where("whole").select("file", "line", "value").union(joined)
    text = F.col("value").cast("string")
    return lines.select("file", F.col("line").alias("line_no"), F.when(F.is_valid_utf8(text), text).alias("value"))
