"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a place whose hash is the strict largest among its neighbours ends a chunk. As that
depends on a few dozen bytes around the place, an insertion moves no boundary but those next to it, and a passage is
cut alike wherever it stands. Of the chunks with one digest the first stays; the others go where they stand side by side
over a passage's length, so that a common phrase that fills a chunk is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.llm.bytescan import ROW, buffers, cut, keyed, sliding
from plyframe.plans.scratch import apart, written

WINDOW = 32
REACH = 32
LEAST = 32
LONGEST = 1024
PASSAGE = 112  # a passage of some fifty words, less what chunks at its ends leave of it
PART = 1 << 22
GEAR = np.random.default_rng(20_240_501).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNKS = "doc_id long, mark long, mark2 long, start int, stop int, d1 long, d2 long, again boolean"


def boundaries(data: np.ndarray, part: int = PART) -> np.ndarray:
    """Places at which a chunk may end, before whole characters only; long data is read part by part."""
    gap, found = WINDOW + REACH, []
    for begin in range(0, len(data), part):
        first = max(0, begin - gap)
        ends = _boundaries(data[first : begin + part + gap]) + first
        found.append(ends[(ends > begin) & (ends <= begin + part)])
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return ends[(data[ends] & 0xC0) != 0x80]


def _boundaries(data: np.ndarray) -> np.ndarray:
    h = GEAR[data]
    done = 1
    while done < WINDOW:  # hash of the last `done` bytes, doubled
        h[done:] = h[done:] + (h[:-done] << np.uint32(done))
        done *= 2
    side = sliding(h, REACH, np.maximum)  # side[i]: over h[i : i + REACH]
    at = np.arange(REACH, len(h) - REACH)
    return at[(h[at] > side[at - REACH]) & (h[at] > side[at + 1][: len(at)])] + 1


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gap = WINDOW + REACH
    for rows, data, first, last in buffers(batches, gap):
        ends, whole = boundaries(data), data.tobytes()
        start, stop, doc = [], [], []
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            inner = ends[np.searchsorted(ends, a + LEAST, "left") : np.searchsorted(ends, b - LEAST, "right")].tolist()
            at = a
            for end in [*inner, b]:
                while end - at > LONGEST:
                    step = at + LONGEST
                    while (whole[step] & 0xC0) == 0x80:
                        step -= 1
                    start.append(at), stop.append(step), doc.append(i)
                    at = step
                if end > at:
                    start.append(at), stop.append(end), doc.append(i)
                at = end
        if not start:
            continue
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(start, stop, strict=True)]), "<i8").reshape(-1, 2)
        doc, start, stop = np.array(doc), np.array(start), np.array(stop)
        order = np.lexsort((digests[:, 1], digests[:, 0], doc))
        d = digests[order]
        same = (d[1:] == d[:-1]).all(axis=1) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(doc), bool)
        again[order[1:][same]] = True
        long = stop - start >= LEAST
        pick = pa.array(doc[long])
        yield pa.RecordBatch.from_arrays(
            [*(rows[c].take(pick) for c in ROW), pa.array((start - first[doc])[long].astype(np.int32)),
             pa.array((stop - first[doc])[long].astype(np.int32)), pa.array(np.ascontiguousarray(digests[long, 0])),
             pa.array(np.ascontiguousarray(digests[long, 1])), pa.array(again[long])],
            [*ROW, "start", "stop", "d1", "d2", "again"])


def deduplicated(docs: DataFrame, id: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text without the chunks that were seen before, where such chunks
    touch over at least `passage` bytes or are all of the text.

    A chunk stays in the first document that has it, at its first place there: the one with the smallest id; rows without
    an id come after all others; different texts with one id or without one are documents of their own, in the order of
    a digest. No boundary is set within LEAST bytes of an end of a text, so only texts shorter than that are shorter
    chunks, and these always stay. Rows equal in id and text are one document, told again: they keep the same chunks. A null text is empty. An empty table gives no rows; other columns are not read. The largest
    chunk has LONGEST bytes, so long runs of one byte are chunks too. A text is read whole, by one task, in linear time.
    """
    chunks = written(keyed(docs, id, text).mapInArrow(_chunked, CHUNKS))
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    several = chunks.groupBy("doc_id").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most")
    if not several.isEmpty():
        rank = F.struct(rank.alias("id"), "mark", "mark2")
    fresh = chunks.where(~F.col("again"))
    owners = fresh.groupBy("d1", "d2").agg(F.min(rank).alias("owner"), F.max(rank).alias("most")).where("owner < most").drop("most")
    taken = fresh.join(apart(owners, "d1"), ["d1", "d2"]).where(rank > F.col("owner"))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("stop") - F.col("start")).alias("size")))
    place = [*ROW, F.array("start").alias("at"), whole.alias("runs")]
    return cut(docs, id, text, taken.select(*place).union(chunks.where("again").select(*place)), passage)
