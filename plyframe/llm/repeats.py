"""Exact substring deduplication by suffix arrays of shards.

Every window of LENGTH bytes is named by the smallest hash among its grams of GRAM bytes (the leftmost one), so equal
windows have equal names and equal places of the gram. Neighbouring windows with one gram form a context: the bytes
they cover. A window is repeated only within the contexts of its name, which therefore make a shard's text:

* a name with one context in all has no repeats, equal contexts repeat in full; neither needs a suffix array;
* different contexts of one name go to one shard, where an induced suffix array and its permuted common prefixes tell
  which windows occur twice;
* a name with too many different contexts for a shard is divided by the place of the gram in the window, in steps of
  39, 10, 3 and 1 places, each part named by the bytes that all its windows share. Contexts shrink with the places, so
  most become equal, and at one place a part's windows are equal by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.llm.bytescan import ROW, buffers, cut, keyed, same, sliding
from plyframe.llm.induced import permuted_common_prefixes, suffix_array
from plyframe.plans.scratch import apart, written

LENGTH = 200
GRAM = 48
STEPS = (39, 10, 3, 1)
CROWD = 200
SHARD = 1_000_000
PART = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 24) - 1)
CONTEXTS = "doc_id long, mark long, mark2 long, name long, digest long, place int, n int, at array<int>"
PARTS = "name long, digest long, part long, twin long, m long, place int, n int, first int, body binary"
RUNS = "name long, digest long, first int, n int"


def _hashes(data: np.ndarray) -> np.ndarray:
    """A rolling hash of the GRAM bytes from each place, built from the hashes of 1, 2, 4, ... bytes."""
    with np.errstate(over="ignore"):
        parts, power, size, h = [], BASE, 1, data.astype(np.uint64) + np.uint64(1)
        while size <= GRAM:
            if GRAM & size:
                parts.append((size, h, power))
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        out, done = None, 0
        for size, h, power in parts:
            out, done = (h, size) if out is None else (out[: len(h) - done] * power + h[done:], done + size)
        out = out ^ (out >> np.uint64(29))
        return out * np.uint64(0xBF58476D1CE4E5B9)


def _contexts(batches: Iterator[pa.RecordBatch], length: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """The contexts of all windows, equal ones of a text in one row with all their places; those of a long text part by
    part, so that a context may be two neighbours."""
    width = length - GRAM + 1
    digest = xxhash.xxh3_64_intdigest
    for rows, data, start, stop in buffers(batches, 1):
        whole = memoryview(data)
        for begin in range(0, len(data) - length + 1, part):
            low, high = np.maximum(start, begin), np.minimum(stop - length + 1, begin + part)
            count = np.maximum(high - low, 0)
            doc = np.flatnonzero(count)
            if not len(doc):
                continue
            h = _hashes(data[begin : begin + part + length - 1])
            gram = (sliding((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width, np.minimum) & PLACE).astype(np.int64)
            count = count[doc]
            of = np.repeat(doc, count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of] - begin
            gram = gram[at]
            first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])
            n = np.diff(np.r_[first, len(of)])
            at, gram, of = at[first], gram[first], of[first]
            place, at = gram - at, at + begin
            digests = np.array([digest(whole[b : b + k + length - 1], p) for b, k, p in zip(at.tolist(), n.tolist(), place.tolist(), strict=True)], np.uint64)
            name = h[gram]
            order = np.lexsort((at, digests, name, of))
            alike = (of[order][1:] == of[order][:-1]) & (name[order][1:] == name[order][:-1]) & (digests[order][1:] == digests[order][:-1])
            head = np.flatnonzero(np.r_[True, ~alike])
            one, pick = order[head], pa.array(of[order[head]])
            places = pa.ListArray.from_arrays(pa.array(np.r_[head, len(order)].astype(np.int32)), pa.array((at - start[of])[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(rows[c].take(pick) for c in ROW), pa.array(name[one].view(np.int64)), pa.array(digests[one].view(np.int64)),
                 pa.array(place[one].astype(np.int32)), pa.array(n[one].astype(np.int32)), places],
                [*ROW, "name", "digest", "place", "n", "at"])


def _searched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows in the contexts of a shard; a task's rows are searched in texts of about SHARD bytes."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).sort_by([("name", "ascending"), ("digest", "ascending")])
    size, name = rows["n"].to_numpy() + length - 1, rows["name"].to_numpy()
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), SHARD)) + at)
        while stop < len(size) and name[stop] == name[stop - 1]:
            stop += 1
        yield _runs(rows.slice(at, stop - at), size[at:stop], length)
        at = stop


def _runs(rows: pa.Table, size: np.ndarray, length: int) -> pa.RecordBatch:
    joined = np.frombuffer(b"\0".join(rows["body"].to_pylist()), np.uint8)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    text = np.empty(len(joined) + 1, np.uint16)
    text[:-1] = joined
    text[:-1] += 2
    text[start[1:] - 1], text[-1] = 1, 0  # 1 between contexts, 0 at the end
    sa = suffix_array(text, 258)
    common = permuted_common_prefixes(text, sa)
    twice = np.zeros(len(text), bool)
    follows = common[sa[1:]] >= length
    twice[sa[1:][follows]] = True
    twice[sa[:-1][follows]] = True
    row = np.repeat(np.arange(len(size)), size + 1)
    left = np.repeat(start + size, size + 1) - np.arange(len(text))
    again = np.flatnonzero(twice & (left >= length))
    head = np.flatnonzero(np.r_[True, (np.diff(again) > 1) | (row[again[1:]] != row[again[:-1]])]) if len(again) else again
    of = row[again[head]]
    pick = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [rows["name"].combine_chunks().take(pick), rows["digest"].combine_chunks().take(pick),
         pa.array((again[head] - start[of]).astype(np.int32)), pa.array(np.diff(np.r_[head, len(again)]).astype(np.int32))],
        ["name", "digest", "first", "n"])


def _divided(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """The parts of contexts by `step` places of the gram: named by the bytes that all windows of the part share."""
    digest = xxhash.xxh3_64_intdigest
    names = ["name", "digest", "part", "twin", "m", "place", "n", "first", "body"]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            body, most = r["body"], r["place"]
            for cell in range((most - r["n"] + 1) // step, most // step + 1):
                last = cell * step + step - 1
                high, low = min(most, last), max(most - r["n"] + 1, cell * step)
                own = body[most - high : most - low + length]
                shared = body[most - cell * step : most - last + length]
                out.append((r["name"], r["digest"], digest(shared, cell), digest(own, high), r["m"], high, high - low + 1, most - high, own))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        hashed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[2:4]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *hashed, pa.array(columns[4], pa.int64()),
             *(pa.array(c, pa.int32()) for c in columns[5:8]), pa.array(columns[8], pa.binary())], names)


def _resolved(contexts: DataFrame, length: int, steps: tuple[int, ...], crowd: int) -> DataFrame:
    """name, digest, runs (first, n): where windows repeat, of different contexts (name, digest, m, place, n, body), a
    scan; m tells how often the context occurs. A context has one row, and as many runs as its windows at most."""
    sizes = written(contexts.groupBy("name").agg(F.count("*").alias("held")).where("held > 1"))
    run = F.array(F.struct("first", "n"))
    whole = contexts.where("m > 1").withColumn("first", F.lit(0)).select("name", "digest", run.alias("runs"))
    size = contexts.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-size // (4 * SHARD)))
    some = contexts.join(sizes.where(F.col("held") <= crowd), "name").select("name", "digest", "n", "body")
    found = some.repartition(shards, "name").mapInArrow(lambda b: _searched(b, length), RUNS)
    runs = whole.union(found.select("name", "digest", run.alias("runs")))
    crowded = sizes.where(F.col("held") > crowd)
    if steps and not crowded.isEmpty():
        many = contexts.join(crowded.drop("held"), "name")
        parts = written(many.mapInArrow(lambda b: _divided(b, length, steps[0]), PARTS))
        twins = written(parts.groupBy(F.col("part").alias("name"), F.col("twin").alias("digest")).agg(
            F.sum("m").alias("m"), F.first("place").alias("place"), F.first("n").alias("n"), F.first("body").alias("body")))
        inner = _resolved(twins, length, steps[1:], crowd).withColumnsRenamed({"name": "part", "digest": "twin"})
        back = parts.select("name", "digest", "part", "twin", F.col("first").alias("_at")).join(apart(inner, "part"), ["part", "twin"])
        runs = runs.union(back.select("name", "digest", F.transform("runs", lambda r: F.struct(
            (r["first"] + F.col("_at")).alias("first"), r["n"].alias("n"))).alias("runs")))
    return runs.groupBy("name", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_spans(docs: DataFrame, id: str, text: str, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Spans, in the form that `bytescan.cut` takes, of each string of `length` bytes that starts elsewhere too."""
    whole = keyed(docs, id, text)
    contexts = written(whole.mapInArrow(lambda b: _contexts(b, length), CONTEXTS))
    names = contexts.groupBy("name").agg(F.sum(F.size("at")).alias("m"), (F.min("digest") != F.max("digest")).alias("mixed"))
    shared = written(contexts.join(apart(names.where("m > 1").drop("m"), "name"), "name"))
    mixed = shared.where("mixed").withColumns({"m": F.size("at"), "at": F.get("at", F.lit(0))}).groupBy("name", "digest").agg(
        F.sum("m").alias("m"), *(F.first(c).alias(c) for c in (*ROW, "place", "n", "at")))
    wanted = mixed.groupBy(*ROW).agg(F.collect_list(F.struct("name", "digest", "m", "place", "n", "at")).alias("wanted"))
    bodies = whole.join(wanted, same(whole, wanted)).select(
        F.transform("wanted", lambda w: F.struct(
            w["name"].alias("name"), w["digest"].alias("digest"), w["m"].alias("m"), w["place"].alias("place"), w["n"].alias("n"),
            F.substring(whole["text"].cast("binary"), w["at"] + 1, w["n"] + F.lit(length - 1)).alias("body"))).alias("wanted"))
    bodies = written(bodies.select(F.explode("wanted").alias("w")).select("w.*"))
    runs = apart(_resolved(bodies, length, STEPS, crowd), "name")
    cover = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), (r["n"] + F.lit(length - 1)).alias("size")))
    found = shared.where("mixed").select("name", "digest", *ROW, "at").join(runs, ["name", "digest"])
    equal = shared.where("NOT mixed").withColumn("runs", F.array(F.struct(F.lit(0).alias("first"), "n")))
    place = [*ROW, "at", cover.alias("runs")]
    return equal.select(*place).union(found.select(*place))


def without_repeats(docs: DataFrame, id: str, text: str, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text (UTF-8) without every byte of a string of `length` bytes that
    starts anywhere else, in the same text or another, before anything is removed. Matches do not cross texts.

    All copies go, so rows that repeat a row lose whatever is long enough. A null text is empty; texts under `length`
    bytes lose nothing. An empty table gives no rows; other columns are not read.
    """
    return cut(docs, id, text, repeated_spans(docs, id, text, length, crowd))
