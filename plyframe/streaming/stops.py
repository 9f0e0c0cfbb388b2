"""The rule that stops a reply, on a stream of the pieces it is generated in.

The state of a reply is what the rule still needs: the last characters, whether the marker was seen, the number of the piece
that comes next, and pieces that came before their turn. It does not grow with the reply. Replies are dealt to buckets by a
hash of model and id, and the states of a bucket are called up together, as a call costs far more than a piece, and kept as
compressed columns.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.text import LONGEST_SAN, MARKER, SAN_CORE

PIECE_SCHEMA = "model STRING, id BIGINT, idx INT, piece STRING, last BOOLEAN"
STOP_SCHEMA = "model STRING, id BIGINT, stop INT, ended STRING"
_STATE = "replies BINARY"  # see `packed`
BUCKETS = 4096
_MARK = re.compile(re.escape(MARKER), re.IGNORECASE | re.ASCII)
_SAN = re.compile(rf"\b({SAN_CORE})\b")
_REACH = LONGEST_SAN + 1


def read_pieces(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON-lines files of pieces: model, id, idx (from 0), piece, last (whether the reply ends with it)."""
    reader = spark.readStream.schema(PIECE_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def grown(tail: str, cut: bool, seen: bool, piece: str) -> tuple[str, bool, bool, bool]:
    """State after a piece, and whether a move stands in the text now. `cut` tells that text before the tail was dropped, so
    that the tail's first character is only there to look back at."""
    text = tail + piece
    if not seen:
        mark = _MARK.search(text)
        if mark is None:
            return text[1 - len(MARKER):], cut, False, False
        text, seen = text[mark.end():], True
    found = _SAN.search(text, 1 if cut else 0) is not None
    return text[-_REACH:], cut or len(text) > _REACH, True, found


def packed(decided: dict[tuple, int], open: dict[tuple, tuple]) -> bytes:
    """Columns of the replies by (model, id) as compressed JSON: of decided ones the time, of others time, tail, cut, seen, n and
    the waiting pieces."""
    columns = [[*zip(*((*reply, at) for reply, at in decided.items()))], [*zip(*((*reply, *v) for reply, v in open.items()))]]
    return zlib.compress(json.dumps(columns, separators=(",", ":")).encode(), 1)


def unpacked(state: bytes) -> tuple[dict[tuple, int], dict[tuple, tuple]]:
    ends, others = json.loads(zlib.decompress(state))
    decided = dict(zip(zip(*ends[:2]), ends[2])) if ends else {}
    return decided, dict(zip(zip(*others[:2]), zip(*others[2:]))) if others else {}


def stop_stream(pieces: DataFrame, after_marker: bool, silence: str | None = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """model, id, stop (how many pieces the reply has when it stops), ended, one row for each reply as soon as it is decided:
    at a `move`, at its `last` piece without one, or after `silence` (stop is null in both).

    Pieces may come in any order and again: those before their turn wait in the state, those that were taken are ignored, as
    is all that comes after the decision. A silence makes Spark go on with empty batches for its timers, so a stream that
    shall end with its input (availableNow) needs None: no timers, and replies without their last piece give no row.

    The replies remembered at a time are dealt to `buckets`, which share a timer for the first of them that falls silent; a
    checkpoint must be gone on with by the same number.
    """
    wait = silence and int(pd.Timedelta(silence).total_seconds() * 1000)

    def work(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if wait else 0
        decided, open = unpacked(bytes(state.get[0])) if state.exists else ({}, {})
        fresh: dict[tuple, list] = {}
        if not state.hasTimedOut:
            for table in tables:
                columns = (table[c].tolist() for c in ("model", "id", "idx", "piece", "last"))
                for model, id, *said in zip(*columns, strict=True):
                    reply = model, id
                    if reply in decided:
                        decided[reply] = now  # a decided reply is forgotten after the same silence
                    elif reply in fresh:
                        fresh[reply].append(said)
                    else:
                        fresh[reply] = [said]
        rows = []
        for reply, came in fresh.items():
            _, tail, cut, seen, n, waiting = open.pop(reply, None) or (now, "", False, not after_marker, 0, ())
            held = {i: (piece, last) for i, piece, last in waiting}
            for idx, piece, last in came:
                if idx >= n and idx not in held:
                    held[int(idx)] = piece or "", bool(last)
            done = False
            while not done and n in held:
                piece, last = held.pop(n)
                tail, cut, seen, found = grown(tail, cut, seen, piece)
                n += 1
                done = found or last
            if done:
                rows.append((*reply, n if found else None, "move" if found else "last"))
                decided[reply] = now
            else:
                open[reply] = now, tail, cut, seen, n, [(i, *v) for i, v in held.items()]
        if wait:
            for reply in [x for x, at in decided.items() if at + wait <= now]:
                del decided[reply]
            for reply in [x for x, v in open.items() if v[0] + wait <= now]:
                rows.append((*reply, None, "silence"))
                del open[reply]
                decided[reply] = now
        if decided or open:
            state.update((packed(decided, open),))
            if wait:
                state.setTimeoutDuration(max(1, min([*decided.values(), *(v[0] for v in open.values())]) + wait - now))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["model", "id", "stop", "ended"]).astype({"stop": "Int32"})

    # text keeps ids exact beside null ones
    named = pieces.select("model", F.col("id").cast("string").alias("id"), "idx", "piece", "last",
                          F.pmod(F.xxhash64("model", "id"), F.lit(buckets)).alias("_bucket"))
    stops = named.groupBy("_bucket").applyInPandasWithState(
        work, STOP_SCHEMA.replace("id BIGINT", "id STRING"), _STATE, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")
    return stops.withColumn("id", F.col("id").cast("long"))
