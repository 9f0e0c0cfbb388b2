"""Sharding by rendezvous hashing: every record goes to the shard that scores highest for its key.

The score of a shard is -weight / ln(u), u being a hash of key and shard in (0, 1): shards get records in proportion to
their weights, and a change of one shard's weight or presence moves only records into or out of that shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.plans.ordinals import gapless
from plyframe.plans.scratch import written

ROWS = 1000


def _scored(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11)
    return F.struct((-F.lit(float(weight)) / F.log((bits + F.lit(0.5)) * F.lit(2.0**-53))).alias("score"),
                    F.lit(-shard).alias("minus"))


def shard_of(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The number of the winning shard among (number, weight) pairs; weights of zero or less take no record, equal
    scores go to the smaller number. A null key is a key like any other."""
    scored = [_scored(key, s, w) for s, w in shards if w > 0]
    if not scored:
        raise ValueError("no shard has a positive weight")
    return -(F.greatest(*scored)["minus"] if len(scored) > 1 else scored[0]["minus"])


def place(records: DataFrame, key: str, text: str, shards: Sequence[tuple[int, float]],
          grown: Sequence[tuple[int, float]]) -> DataFrame:
    """One row for each record: key, size, text_crc32, shard, grown_shard (under the shards `grown`) and slot, the
    record's gapless number in its shard.

    A null text has size 16 and the checksum of no bytes. Rows that repeat a key go to one shard, each to a slot of its
    own. An empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = written(records.select(
        F.col(key).alias("key"), (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row")))
    parts = -(-narrow.count() // (len(shards) * ROWS)) or 1
    return gapless(narrow, ["shard"], F.lit(parts), "row").drop("row")
