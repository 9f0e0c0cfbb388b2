"""Text files under names of the caller's choice, that appear whole when the job commits or not at all.

A data source writer: tasks write drafts and report them, and only the commit of the job gives the drafts of its successful
tasks their names. The drafts of failed and of repeated tasks are never named; those of a job that fails are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _register(spark: SparkSession) -> None:
    # Classes are made here so that they travel to the workers by value.
    class Drafts(WriterCommitMessage):
        def __init__(self, files):
            self.files = files

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            self.folder = options["path"].rstrip("/")

        def place(self):
            from pyarrow import fs

            if ":/" in self.folder:
                return fs.FileSystem.from_uri(self.folder)
            return fs.LocalFileSystem(), self.folder

        def write(self, iterator):
            import uuid

            filesystem, base = self.place()
            filesystem.create_dir(f"{base}/_drafts", recursive=True)
            files, out = [], None
            try:
                for batch in iterator:
                    for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist()):
                        if not files or name != files[-1][1]:
                            if out is not None:
                                out.close()
                            files.append((f"{base}/_drafts/{uuid.uuid4().hex}", name))
                            out = filesystem.open_output_stream(files[-1][0])
                        out.write(f"{value}\n".encode())
            except BaseException:
                if out is not None:
                    out.close()
                for draft, _ in files:
                    filesystem.delete_file(draft)
                raise
            if out is not None:
                out.close()
            return Drafts(files)

        def commit(self, messages):
            filesystem, base = self.place()
            for message in messages:
                for draft, name in message.files if message else ():
                    filesystem.move(draft, f"{base}/{name}")

        def abort(self, messages):
            filesystem, _ = self.place()
            for message in messages:
                for draft, _ in message.files if message else ():
                    filesystem.delete_file(draft)

    class CommittedLines(DataSource):
        @classmethod
        def name(cls):
            return "committed_lines"

        def schema(self):
            return "file STRING, line BIGINT, value STRING"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(CommittedLines)


def write_committed(lines: DataFrame, folder: str) -> None:
    """Write rows (file, line, value) as `folder`/`file`, each in the order of `line` and by one task, so a file should have a
    bounded number of lines. Files of the same names are replaced. If any task fails for good, no file appears."""
    _register(lines.sparkSession)
    ordered = lines.select("file", "line", "value").repartition("file").sortWithinPartitions("file", "line")
    ordered.write.format("committed_lines").mode("append").save(folder)
