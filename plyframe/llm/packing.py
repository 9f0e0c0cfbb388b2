"""Packing by shortest-pack-first over the histogram of lengths.

Only the histogram, one count per length, is packed: lengths are placed longest first, each into the shortest packs
that still have room, and packs with the same content are one pattern with a count. Pieces then find their place by
joining their rank among the pieces of their length to the ranges of ranks that the patterns take.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.plans.ordinals import gapless

BROADCAST_ROWS = 200_000
ROWS = 1000
CACHED = 400_000
SPAN = 1 << 20
UNSAFE = re.compile(r" (?<=\s )(?:\s|\Z)")
LATIN = re.compile("[\x00-\u024f]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary as bytes: printable Latin-1 characters stand for themselves, those from U+0100 for the other bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = tokenizer.get_added_tokens_decoder()
    return {bytes(byte[c] for c in t): i for t, i in tokenizer.get_vocab().items() if i not in added}


class Encoder(dict):
    """The ids of words led by a space as bytes, remembered up to a bound; a byte-level vocabulary file of `tokenizers`.

    The vocabulary's splitting never joins a word and the space after it, so a text is cut before each space that lies
    between a word and a word or other single separator; a text with longer runs of blanks is encoded whole. New words in
    Latin letters, about which all libraries agree, are merged by `tiktoken` with the same ranks, which is faster.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.latin = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=_ranks(self.tokenizer), special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self[word] = self.whole(f" {word}")
        return ids

    def whole(self, text: str) -> bytes:
        if LATIN.fullmatch(text) and not any(t in text for t in self.special):
            ids = self.latin.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.whole(text)
        parts, at = [], 0
        while at < len(text):  # each part but the first begins with a space
            stop = text.find(" ", at + SPAN)
            head, *words = text[at : stop if stop >= 0 else len(text)].split(" ")
            parts += [self.whole(head) if head else b"", *map(self.__getitem__, words)]
            at = stop if stop >= 0 else len(text)
        return b"".join(parts)


def pieces(docs: DataFrame, id: str, text: str, vocabulary: str, most: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens: each document's ids followed by `end`,
    cut into pieces of `most` ids and a last shorter one. A null text is empty, so its one id is `end`."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(vocabulary), np.array([end], "<u4").tobytes()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.ids(body.as_py() or "") + last
                n = len(ids) // 4
                rows += [(doc.as_py(), at, min(most, n - at), ids[4 * at : 4 * (at + most)], n) for at in range(0, n, most)]
                held += len(ids)
                if held > 8_000_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        yield _batch(rows, schema)

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def patterns(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in a pack): shortest pack first, longest lengths first."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=0)
            if not room:
                by_room.setdefault(most - length, []).append((left, (length,)))
                break
            count, held = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            if count > left:
                by_room.setdefault(room, []).append((count - left, held))
            used = min(count, left)
            by_room.setdefault(room - length, []).append((used, (*held, length)))
            left -= used
    return [(count, list(held)) for found in by_room.values() for count, held in found]


def pack(table: DataFrame, length: str, row: str, most: int = 1024) -> DataFrame:
    """The rows of `table`, written with their number `row`, with sequence_id and offset: rows of one sequence do not overlap and
    start at 0 without gaps; no sequence is longer than `most`.

    Lengths lie from 1 to `most`, else it raises. Every row gets a place, repeated rows too; an empty table gives no
    rows. Only the histogram, at most `most` counts, comes to the driver. Its patterns are broadcast if they are few,
    which `most` and not the data decides, and joined by length otherwise.
    """
    spark = table.sparkSession
    counted = table.groupBy(F.col(length).cast("int").alias("n")).count().collect()
    histogram = {r["n"]: r["count"] for r in counted}
    if any(n is None or not 1 <= n <= most for n in histogram):
        raise ValueError(f"a length is not between 1 and {most}")
    taken, entries, sequences = dict.fromkeys(histogram, 0), [], 0
    for count, held in patterns(histogram, most):
        offset = 0
        for n in held:
            entries.append((n, taken[n], taken[n] + count, sequences - taken[n], offset))
            taken[n] += count
            offset += n
        sequences += count
    sizes = spark.createDataFrame([(n, -(-c // ROWS)) for n, c in histogram.items()], "_length int, _parts long")
    ranked = table.withColumn("_length", F.col(length).cast("int")).join(F.broadcast(sizes), "_length")
    ranked = gapless(ranked, ["_length"], F.col("_parts"), row, "_rank")
    ranges = spark.createDataFrame(entries, "_length int, _from long, _to long, _shift long, offset long")
    if len(entries) <= BROADCAST_ROWS:
        ranges = F.broadcast(ranges)
    inside = (ranked["_length"] == ranges["_length"]) & (ranked["_rank"] >= ranges["_from"]) & (ranked["_rank"] < ranges["_to"])
    return ranked.join(ranges, inside).select(
        *table.columns, (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset")

