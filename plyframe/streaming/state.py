"""Where a stream keeps what it remembers between batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

KEPT_IN_FILES = {"spark.sql.streaming.maxBatchesToRetainInMemory": "0", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
PARTITIONS = "spark.sql.shuffle.partitions"
MB_A_PARTITION = 64


@contextmanager
def state_in_files(spark: SparkSession, partitions: int = 1) -> Iterator[None]:
    """Streams started in this block keep their state in the checkpoint's files only, so that an executor holds the state
    of the partitions it works on and not several versions of all; the state is in `partitions` or as many as the session
    shuffles to, if those are more. They make no batches without input, which would only clear state.

    For streams that end with their input: each batch reads the changes of all batches before it, which are not merged.
    """
    settings = KEPT_IN_FILES | {PARTITIONS: str(max(partitions, int(spark.conf.get(PARTITIONS))))}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def partitions_of(spark: SparkSession, folder: str) -> int:
    """A partition for each 64 MB of the files in `folder`, which are listed and not read."""
    size = spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0] or 0
    return 1 + size // (MB_A_PARTITION << 20)
