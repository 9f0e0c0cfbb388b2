"""Whole-buffer scans of bytes with numpy, shared by the substring operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUFFER = 1 << 20
ROW = ["doc_id", "mark", "mark2"]


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, mark, mark2, text: the id and a digest of the text name a row; rows equal in them are copies of one row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), *marks(body), body.alias("text"))


def marks(body: Column) -> list[Column]:
    """mark, mark2: 120 bits of the text's digest, as numbers, which aggregates hold in place."""
    digest = F.md5(body.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for name, at in (("mark", 1), ("mark2", 16))]


def same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one id and one text."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"]) & (a["mark2"] == b["mark2"])


def buffers(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a few rows at a time as one buffer of about BUFFER bytes: rows, bytes, starts and ends of the texts.

    At least `gap` zero bytes lie before and after each text, so nothing that is read around a place of a text depends
    on its neighbours in the buffer. A longer text is a buffer of its own.
    """
    for batch in batches:
        texts = [t.encode("utf-8", "replace") for t in batch["text"].to_pylist()]
        at = 0
        while at < len(texts):
            stop, held = at + 1, len(texts[at])
            while stop < len(texts) and held + len(texts[stop]) <= BUFFER:
                held += len(texts[stop])
                stop += 1
            space = bytes(gap)
            data = np.frombuffer(space + b"".join(x + space for x in texts[at:stop]), np.uint8)
            size = np.array([len(x) for x in texts[at:stop]], np.int64)
            start = gap + np.r_[0, np.cumsum(size + gap)[:-1]]
            yield batch.slice(at, stop - at), data, start, start + size
            at = stop


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each i that has so many values; best is np.minimum or np.maximum."""
    done, out = 1, x
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def cut(docs: DataFrame, id: str, text: str, spans: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of `docs`: its text without the spans.

    A row (doc_id, mark, mark2, at, runs) of `spans` stands for a span from place + first of `size` bytes for each place of `at`
    and each run (first, size), in bytes of the texts of `keyed`. Spans may overlap; those that touch count as one,
    and one of under `least` bytes stays, unless it is the whole text. Rows of `spans` that repeat are held once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, body, cuts in zip(batch["doc_id"], batch["text"], batch["cuts"], strict=True):
                rows.append((doc.as_py(), *_cut(body.as_py().encode("utf-8", "replace"), cuts.as_py(), least)))
                held += rows[-1][1]
                if held > 8 * BUFFER:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    whole = keyed(docs, id, text)
    found = spans.groupBy(*ROW).agg(F.collect_set(F.struct("at", "runs")).alias("cuts"))
    joined = whole.join(found, same(whole, found), "left").select(whole["doc_id"], whole["text"], "cuts")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def rewritten(docs: DataFrame, id: str, text: str, spans: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with the spans cut from `text`. A character of which only a part is left goes
    with its span; a null text stays null."""
    names = docs.columns
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch["row"].flatten()
            kept = [_cut(x.encode("utf-8", "replace"), c)[3].decode("utf-8", "ignore") if c else x
                    for x, c in zip(columns[at].to_pylist(), batch["cuts"].to_pylist(), strict=True)]
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(F.col(id).cast("long").alias("doc_id"), *marks(body), F.struct(*docs.columns).alias("row"))
    found = spans.groupBy(*ROW).agg(F.collect_set(F.struct("at", "runs")).alias("cuts"))
    return whole.join(found, same(whole, found), "left").select(whole["row"], "cuts").mapInArrow(work, docs.schema)


def _cut(body: bytes, cuts: list[dict] | None, least: int = 1) -> tuple[int, int, int, bytes]:
    runs: list[list[int]] = []
    for start, stop in sorted((p + r["first"], p + r["first"] + r["size"]) for c in cuts or () for p in c["at"] for r in c["runs"]):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    runs = [r for r in runs if r[1] - r[0] >= least or r == [0, len(body)]]
    ends = [0, *(stop for _, stop in runs)]
    kept = [body[a:b] for a, b in zip(ends, [*(start for start, _ in runs), len(body)], strict=True)]
    return len(body), sum(b - a for a, b in runs), len(runs), b"".join(kept)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

