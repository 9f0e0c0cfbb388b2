"""Text lines of zstd files with windows beyond what Spark's own reader accepts.

A Python data source: one partition per file, decoded as a stream in its task, handed on in Arrow
batches. Lines come with their number, so the order of the file is a key. The last line counts only
if it is ended by a newline, as in the original streaming reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# --- fixed values -------------------------------------------------------------------------
MAX_WINDOW = 2**31
# ------------------------------------------------------------------------------------------

_BATCH = 4096
_CHUNK = 1 << 20


def _register(spark: SparkSession) -> None:
    # Classes are made here so that they travel to the workers by value.
    class OneFile(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.pattern = options["path"]
            self.max_window = int(options.get("maxwindow", MAX_WINDOW))

        def partitions(self):
            import fnmatch

            from pyarrow import fs

            filesystem, path = fs.FileSystem.from_uri(self.pattern) if "://" in self.pattern else (
                fs.LocalFileSystem(), self.pattern)
            folder, _, last = path.rpartition("/")
            if filesystem.get_file_info(path).type == fs.FileType.Directory:
                folder, last = path, "*.zst"
            names = [i.path for i in filesystem.get_file_info(fs.FileSelector(folder))
                     if i.is_file and fnmatch.fnmatch(i.base_name, last)]
            scheme = self.pattern.split("://")[0] + "://" if "://" in self.pattern else ""
            return [OneFile(scheme + n) for n in sorted(names)]

        def read(self, partition):
            import pyarrow as pa
            import zstandard
            from pyarrow import fs

            filesystem, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (
                fs.LocalFileSystem(), partition.path)
            names = ["file", "line_no", "value"]
            types = [pa.string(), pa.int64(), pa.string()]

            def text(line):
                try:
                    return line.decode()
                except UnicodeDecodeError:
                    return None

            def batch(first, values):
                columns = [[partition.path] * len(values), list(range(first, first + len(values))), values]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

            with filesystem.open_input_stream(path, compression=None) as raw:
                stream = zstandard.ZstdDecompressor(max_window_size=self.max_window).stream_reader(
                    raw, read_across_frames=True)
                rest, lines, number = b"", [], 0
                while chunk := stream.read(_CHUNK):
                    *whole, rest = (rest + chunk).split(b"\n")
                    lines += [text(w) for w in whole]
                    while len(lines) >= _BATCH:
                        yield batch(number, lines[:_BATCH])
                        number, lines = number + _BATCH, lines[_BATCH:]
                if lines:
                    yield batch(number, lines)

    class ZstdLines(DataSource):
        @classmethod
        def name(cls):
            return "zstd_lines"

        def schema(self):
            return "file STRING, line_no BIGINT, value STRING"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(ZstdLines)


def read_zstd_lines(spark: SparkSession, path: str, max_window: int = MAX_WINDOW) -> DataFrame:
    """Columns file, line_no, value; null for a line that is not UTF-8. `path` is a file, a folder of *.zst, or a pattern."""
    _register(spark)
    return spark.read.format("zstd_lines").option("maxwindow", max_window).load(path)


def write_zstd_lines(lines: DataFrame, folder: str, finished: bool = True, frame_bytes: int | None = None) -> None:
    """Write rows (file, line, value) as `folder`/`file`.zst, each file in the order of `line` and by one task.

    Without `finished` the last line of a file is not ended. With `frame_bytes` a frame ends after as many bytes of text, in the
    middle of a line too; otherwise a file is one frame. A file gets its name when it is complete, so a task that
    is tried again leaves no part of a file.
    """
    def work(batches):
        import uuid

        import zstandard
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        filesystem.create_dir(base, recursive=True)
        name = raw = out = draft = None
        room = frame_bytes

        def write(data):
            nonlocal out, room
            while frame_bytes and len(data) > room:
                out.write(data[:room])
                out.close()
                out, data, room = zstandard.ZstdCompressor().stream_writer(raw, closefd=False), data[room:], frame_bytes
            out.write(data)
            room = frame_bytes and room - len(data)

        def close():
            if out is not None:
                if finished:
                    write(b"\n")
                out.close()
                raw.close()
                filesystem.move(draft, f"{base}/{name}.zst")

        for batch in batches:
            for file, value in zip(batch["file"], batch["value"]):
                if file != name:
                    close()
                    name, draft = file, f"{base}/.{uuid.uuid4().hex}"
                    raw = filesystem.open_output_stream(draft)
                    out, room = zstandard.ZstdCompressor().stream_writer(raw, closefd=False), frame_bytes
                else:
                    write(b"\n")
                write(value.encode())
        close()
        yield from ()

    ordered = lines.select("file", "line", "value").repartition("file").sortWithinPartitions("file", "line")
    ordered.mapInPandas(work, "file string").write.format("noop").mode("overwrite").save()
