"""Phrases whose words come together more often than apart, per language.

Words that are frequent enough get ids by frequency. Adjacent ids are counted batch by batch: the ranks are split into
tiles, and a tile with many pairs is counted by direct address in a dense array, the rest as sorted coordinates. Batches'
counts are dealt to shards by a hash of the pair, a packed row for a batch and shard, and added there: a pair takes some three
bytes of a shuffle, not a row. Frequent pairs are ranked by frequency in their turn, so that two pairs which share a word are
adjacent ids of the next level and make a phrase of three words, and so on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written

SPAN = 1 << 20  # bytes of a text split into words at a time
HOLD = 1 << 21  # words of a batch
TILE, HEAD = 512, 16  # ranks in a tile's side, tiles in a side of the square that may be counted by direct address
DENSE = TILE * TILE // 32  # pairs that make a tile worth an array
MARKS = bytes.maketrans(b"\t,;:!?\x0a\x0b\x0c\x0d", b" " + b"." * 9)  # a tab is a blank; all that ends a piece is a dot
BUCKETS = 64
SHARDS = 32  # at least; there are as many as batches, so that a shard's pairs grow with HOLD and not with the input


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: all lowest bytes, then all second bytes, as far as the largest needs them."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8)
    out = np.zeros((len(planes) // data[0], 8), np.uint8)
    out[:, : data[0]] = planes.reshape(data[0], -1).T
    return out.view("<i8").ravel()


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that are equal in `key`."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=itemgetter(*key))


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Held:
    """The words of one language since the last batch; number 0 ends a piece."""

    def __init__(self) -> None:
        self.ids, self.seqs = Ids({b".": 0}), []

    def add(self, part: bytes) -> int:
        said = part.replace(b".", b" . ").split()
        self.seqs.append(np.fromiter(map(self.ids.__getitem__, said), "<i4", len(said)))
        self.seqs.append(np.zeros(1, "<i4"))
        return len(said)

    def row(self, lang: str) -> tuple:
        seq = np.concatenate(self.seqs)
        words = [w.decode() for w in self.ids][1:]
        return lang, words, np.bincount(seq, minlength=len(words) + 1)[1:].tolist(), pack(seq)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words, each of one language: distinct words, their counts, and the words' numbers from 1 in text order,
    packed, 0 between pieces."""
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
    held: dict[str, Held] = {}
    words = 0

    def flushed() -> pa.RecordBatch:
        rows = list(zip(*(h.row(lang) for lang, h in held.items()), strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["lang", "words", "counts", "seq"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            body = (text.as_py() or "").encode("utf-8", "replace").lower().translate(MARKS)
            at = 0
            while at < len(body):
                stop = body.find(b".", at + SPAN)
                stop = stop if stop >= 0 else len(body)
                words += held.setdefault(lang.as_py(), Held()).add(body[at:stop])
                at = stop
                if words >= HOLD:
                    yield flushed()
                    held, words = {}, 0
    yield flushed()


def adjacent(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of adjacent numbers of `seq`: their numbers in text order (-1 for none), left ids, right ids and counts.

    `ids` gives the rank of a number, -1 for none; a pair needs two. A tile of ranks with DENSE pairs is counted by direct
    address, the others' pairs are sorted.
    """
    rank = np.append(ids, -1)[seq]  # -1 finds the last
    place = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
    out = np.full(max(0, len(seq) - 1), -1, np.int64)
    left, right = rank[place], rank[place + 1]
    head = TILE * HEAD
    tile = np.where((left < head) & (right < head), left // TILE * HEAD + right // TILE, HEAD * HEAD).astype(np.int16)
    many = np.bincount(tile, minlength=HEAD * HEAD + 1) >= DENSE
    many[-1] = False
    tile[~many[tile]] = HEAD * HEAD
    order = np.argsort(tile, kind="stable")
    starts = np.searchsorted(tile[order], np.arange(HEAD * HEAD + 2))
    found: list[tuple[np.ndarray, ...]] = []
    n = 0
    for t in np.flatnonzero(many):
        own = order[starts[t] : starts[t + 1]]
        cell = left[own] % TILE * TILE + right[own] % TILE
        counts = np.bincount(cell, minlength=TILE * TILE)
        used = np.flatnonzero(counts)
        number = np.zeros(TILE * TILE, np.int64)
        number[used] = np.arange(n, n + len(used))
        out[place[own]] = number[cell]
        found.append((t // HEAD * TILE + used // TILE, t % HEAD * TILE + used % TILE, counts[used]))
        n += len(used)
    rest = order[starts[HEAD * HEAD] :]
    # the batch's own numbers fit one word, ranks need not
    key = seq[place[rest]].astype(np.int64) * len(ids) + seq[place[rest] + 1]
    _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    out[place[rest]] = number + n
    found.append((left[rest[first]], right[rest[first]], counts))
    return out, *(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))


COUNTED = {"shard": pa.int32(), "lang": pa.string(), "batch": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
COUNTED_SQL = "shard int, lang string, batch long, a binary, b binary, c binary"


def _dealt(left: np.ndarray, right: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' places by shard, in a shard by left id, and the shards' starts."""
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(left, kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _counted(batches: Iterator[pa.RecordBatch], level: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch: kind 0 its sequence, kind 1 the ids of its words, kinds 2 to `level` the ids of its numbers there,
    by shard and place in the shard. Out: the pairs of adjacent ids of that level, a row for a shard: left ids (as
    differences), right ids, counts."""
    now, lang, seq, words, maps = None, None, None, [], {}

    def done() -> pa.RecordBatch:
        own, order, starts = seq, None, None
        for k in range(1, level + 1):
            ids = np.full(int(own.max(initial=-1)) + 1, -1, np.int64)
            for at, id in words if k == 1 else [(order[starts[shard] + at], id) for shard, at, id in maps.get(k, [])]:
                ids[at] = id
            own, left, right, times = adjacent(own, ids)
            order, starts = _dealt(left, right, shards)
        rows = []
        for shard in np.flatnonzero(np.diff(starts)):
            at = order[starts[shard] : starts[shard + 1]]
            rows.append((int(shard), lang, now, pack(np.diff(left[at], prepend=0)), pack(right[at]), pack(times[at])))
        return _rows(COUNTED, rows)

    for batch in batches:
        name, kind = batch["batch"].to_numpy(), batch["kind"].to_numpy()
        bounds = np.flatnonzero((np.diff(name) != 0) | (np.diff(kind) != 0)) + 1
        for start, stop in zip([0, *bounds], [*bounds, len(name)], strict=True):
            if stop == start:
                continue
            if name[start] != now:
                if now is not None:
                    yield done()
                now, words, maps = int(name[start]), [], {}
            part = batch.slice(start, stop - start)
            if kind[start] == 0:
                lang, seq = part["lang"][0].as_py(), unpack(part["seq"][0].as_py()) - 1
            elif kind[start] == 1:
                words.append((part["at"].to_numpy(), part["id"].to_numpy()))
            else:
                of = zip(part["at"].to_pylist(), part["seq"].to_pylist(), part["ids"].to_pylist(), strict=True)
                maps.setdefault(int(kind[start]), []).extend((shard, np.cumsum(unpack(at)), unpack(id)) for shard, at, id in of)
    if now is not None:
        yield done()


def _added(batches: Iterator[pa.RecordBatch], least: int, back: bool) -> Iterator[pa.RecordBatch]:
    """Rows of `_counted` sorted by shard and language. Out: a row without batch with the pairs that occur `least` times or more (left
    ids, right ids, counts) and, with `back`, a row for each batch that has some: their places in its row (as
    differences) and which of those pairs they are."""
    for (shard, lang), rows in _groups(batches, ["shard", "lang"]):
        names, lefts, rights, counts = [], [], [], []
        for row in rows:
            names.append(row["batch"])
            lefts.append(np.cumsum(unpack(row["a"])))
            rights.append(unpack(row["b"]))
            counts.append(unpack(row["c"]))
        ends = np.cumsum([len(x) for x in lefts])
        first, left = np.unique(np.concatenate(lefts), return_inverse=True)
        second, right = np.unique(np.concatenate(rights), return_inverse=True)
        pair, number = np.unique(left * len(second) + right, return_inverse=True)
        f = np.zeros(len(pair), np.int64)
        np.add.at(f, number, np.concatenate(counts))
        often = f >= least
        if not often.any():
            continue
        out = [(shard, lang, None, pack(first[pair[often] // len(second)]), pack(second[pair[often] % len(second)]), pack(f[often]))]
        rank = np.where(often, np.cumsum(often) - 1, -1)[number]
        for name, own in zip(names, np.split(rank, ends[:-1]), strict=True) if back else ():
            at = np.flatnonzero(own >= 0)
            if len(at):
                out.append((shard, lang, name, pack(np.diff(at, prepend=0)), pack(own[at]), None))
        yield _rows(COUNTED, out)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of `_added` as rows, with their shard and place in its row."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right, f = (unpack(row[c]) for c in "abc")
            n = len(f)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["lang"], pa.string()), n), pa.array(left), pa.array(right), pa.array(f),
                                              pa.repeat(pa.scalar(row["shard"], pa.int32()), n), pa.array(np.arange(n))],
                                             ["lang", "left", "right", "f", "shard", "place"])


NUMBERED = {"batch": pa.int64(), "at": pa.int64(), "seq": pa.binary(), "ids": pa.binary()}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, language and kind: kind 0 ids of pairs by place, kind 1 the rows of `_added` for a batch. Out: those
    rows with the ids."""
    now, ids = None, []
    for batch in batches:
        names = zip(*(batch[c].to_pylist() for c in ("shard", "lang", "kind")), strict=True)
        out, start = [], 0
        for (shard, lang, kind), run in groupby(names):
            part = batch.slice(start, len(list(run)))
            start += len(part)
            if (shard, lang) != now:
                now, ids = (shard, lang), []
            if kind == 0:
                ids.append((part["place"].to_numpy(), part["id"].to_numpy()))
                continue
            table = np.zeros(sum(len(p) for p, _ in ids), np.int64)
            for place, id in ids:
                table[place] = id
            out += [(b, shard, a, pack(table[unpack(n)])) for b, a, n in zip(*(part[c].to_pylist() for c in ("batch", "a", "b")), strict=True)]
        if out:
            yield _rows(NUMBERED, out)


def _frequent_pairs(pairs: DataFrame, least: int, back: bool) -> tuple[DataFrame, DataFrame | None]:
    """From the rows of `_counted`: each language's pairs that occur `least` times or more with f and, with `back`, an id by
    falling f, and the ids of each batch's numbers."""
    dealt = pairs.repartition("shard").sortWithinPartitions("shard", "lang")
    held = written(dealt.mapInArrow(lambda b: _added(b, least, back), COUNTED_SQL))
    keys = held.where("batch IS NULL").mapInArrow(_spread, "lang string, left long, right long, f long, shard int, place long")
    if not back:
        return keys.select("lang", "left", "right", "f", F.lit(0).cast("long").alias("id")), None
    ranked = written(dense_ordinal(keys.withColumn("less", -F.col("f")), ["less", "left", "right"], ["lang"], out="id").drop("less"))
    none = F.lit(None)
    rows = ranked.select("shard", "lang", F.lit(0).alias("kind"), "place", "id", none.cast("long").alias("batch"), none.cast("binary").alias("a"), none.cast("binary").alias("b"))
    rows = rows.union(held.where("batch IS NOT NULL").select("shard", "lang", F.lit(1), none.cast("long"), none.cast("long"), "batch", "a", "b"))
    ids = rows.repartition("shard").sortWithinPartitions("shard", "lang", "kind").mapInArrow(_numbered, "batch long, at long, seq binary, ids binary")
    return ranked.drop("shard", "place"), ids


def _frequent(rows: DataFrame, key: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """From batches' counts (batch, at, lang, key, times): each language's keys with a sum f of `least` or more and an id by
    falling f, and the ids of each batch's numbers. A key has a row for a batch, so the largest group is the number of
    batches."""
    whole = Window.partitionBy(*key, "lang")  # the sort compares its first key fastest
    held = written(rows.withColumn("f", F.sum("times").over(whole)).where(F.col("f") >= least).drop("times"))
    keys = held.select("lang", *key, "f").distinct().withColumn("less", -F.col("f"))
    ranked = written(dense_ordinal(keys, ["less", *key], ["lang"], out="id").drop("less"))
    return ranked, held.join(ranked.drop("f"), [*key, "lang"]).select("batch", "at", "id")


def phrases(docs: DataFrame, text: str, lang: str, least: int = 10, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all words of a language), and every phrase of 2 to `most` words that occurs `least` times or more: lang, size, phrase,
    f, heads and tails (how often its first and its last 1, 2, ... words occur), within (how often the most frequent phrase
    of one word more that holds it occurs, 0 for none)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    batches = rows.mapInArrow(_encoded, "lang string, words array<string>, counts array<long>, seq binary")
    batches = written(batches.withColumn("batch", F.monotonically_increasing_id()))
    sizes = batches.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    local = batches.select("batch", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "of"))
    words, ids = _frequent(local.select("batch", "lang", F.col("at").cast("long").alias("at"), F.col("of.words").alias("word"), F.col("of.counts").alias("times")),
                           ["word"], least)
    none = F.lit(None)
    empty = F.array().cast("array<long>")
    level = words.select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), empty.alias("heads"), empty.alias("tails"))
    fed = batches.select("batch", F.lit(0).alias("kind"), none.cast("long").alias("at"), none.cast("long").alias("id"), "lang", "seq", none.cast("binary").alias("ids"))
    ids = ids.select("batch", F.lit(1).alias("kind"), "at", "id", none.cast("string").alias("lang"), none.cast("binary").alias("seq"), none.cast("binary").alias("ids"))
    shards = max(SHARDS, batches.count())
    found = []
    for size in range(2, most + 1):
        fed = fed.union(written(ids) if size < most else ids)
        ordered = fed.repartition("batch").sortWithinPartitions("batch", "kind")
        pairs = ordered.mapInArrow(lambda b, depth=size - 1: _counted(b, depth, shards), COUNTED_SQL)
        keys, back = _frequent_pairs(pairs, least, size < most)
        if back is not None:
            ids = back.select("batch", F.lit(size).alias("kind"), "at", none.cast("long").alias("id"), none.cast("string").alias("lang"), "seq", "ids")
        holds = keys.select("lang", F.explode(F.array("left", "right")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("within"))
        if size > 2:
            found.append(level.join(holds, ["id", "lang"], "left"))
        one = level.select("lang", F.col("id").alias("left"), F.col("phrase").alias("begun"), F.concat("heads", F.array("f")).alias("heads"))
        two = level.select("lang", F.col("id").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
        level = written(keys.join(one, ["left", "lang"]).join(two, ["right", "lang"]).select(
            "lang", "id", "f", F.concat_ws(" ", "begun", "last").alias("phrase"), "last", "heads", "tails"))
    found.append(level.withColumn("within", none.cast("long")))
    whole = None
    for at, table in enumerate(found):
        table = table.select("lang", F.lit(at + 2).alias("size"), "phrase", "f", "heads", "tails", F.coalesce("within", F.lit(0)).alias("within"))
        whole = table if whole is None else whole.union(table)
    return sizes, whole


def collocations(docs: DataFrame, text: str, lang: str, top: int = 2000, least: int = 10, most: int = 3, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    The score of a cut after k words is floor(1000000 a a / (l r)) for the counts of the phrase and of its two parts; the
    lowest cut counts, the smallest k on a tie. Phrases that lie in a longer one with `share` percent of their count or
    more are left out. Better scores first, then larger counts, then bytes of the phrase.

    A null text is empty, a null language is `und`; repeated rows count again. An empty table gives no rows; other columns
    are not read. Products are decimals of 38 digits, enough for counts up to 10^15.
    """
    sizes, found = phrases(docs, text, lang, least, most)
    open_ = found.where(F.col("within") * 100 < F.col("f") * share)
    square = F.col("f").cast("decimal(15,0)")
    cuts = F.transform("heads", lambda l, k: F.struct(l.alias("l"), F.element_at("tails", (F.col("size") - k - 1).cast("int")).alias("r"), k.alias("k")))
    split = open_.select("lang", "phrase", "f", "size", F.explode(cuts).alias("cut")).select(
        "lang", "phrase", "f", "cut.k", "cut.l", "cut.r", (square * square * F.lit(1_000_000).cast("decimal(7,0)")).alias("top"),
        (F.col("cut.l").cast("decimal(15,0)") * F.col("cut.r").cast("decimal(15,0)")).alias("bottom"))
    scored = split.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
