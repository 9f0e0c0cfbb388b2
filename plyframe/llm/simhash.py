"""SimHash near-duplicates through deletion variants.

Two 64-bit fingerprints with at most four differing bits are cut into three segments; one of the three differs in one
bit at most. Every segment is indexed with each of its bits left out: segments that differ in one bit agree where that
bit is left out, equal ones agree anyway. Fingerprints that share such a variant are compared, and components of the
links that hold are the groups of near-duplicates.

Four bits reach few copies of a similarity under 0.95. `representatives` takes the groups of linked fingerprints as its
first candidates, adds bands of minima of shingle hashes for the copies that fingerprints miss, and compares shingles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.llm.bytescan import keyed
from plyframe.llm.components import components
from plyframe.plans.scratch import apart, written

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MOST = 4
PAIRED = 16
CROWD = 100_000
BLOCK = 65_536
SPAN = 1 << 20
SHINGLE = 5
SHARE = 0.8
BANDS, MINIMA = 20, 5
MIXED = np.random.default_rng(20_240_502).integers(0, 1 << 64, (2, BANDS * MINIMA, 1), dtype=np.uint64)
AGREE = 60  # of the 100 minima, by one byte of each
HUBBED = 4_096
COMPARED = 1_000
SKETCH = "doc_id long, digest string, node long, n int, fp long, bands array<long>, bytes binary"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
ROWS = 400_000


def _hashes(said: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of `words` words, BLOCK at a time."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(said)
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(said) - words + 1]
    ends = ends[words - 1 :]
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8")


def shingles(text: str | None, words: int, span: int = SPAN) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, in pieces; a long text is split into words part by part."""
    body = (text or "").encode("utf-8", "replace").lower()
    held, at, some = [], 0, False
    while at < len(body):
        stop = BLANK.search(body, at + span)
        stop = stop.start() if stop else len(body)
        held += body[at:stop].split()
        at = stop
        last = at >= len(body)
        if len(held) >= words or last and held and not some:
            some = True
            yield from _hashes(held, min(words, len(held)))
            held = held[1 - words :] if words > 1 else []


def fingerprint(text: str | None, words: int = 4, span: int = SPAN) -> int:
    """The fingerprint as a signed 64-bit number; no words give 0."""
    return _majority(shingles(text, words, span))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes, as a signed number; no hashes give 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, id: str, text: str, words: int = 4) -> DataFrame:
    """doc_id, mark (a checksum of the text), fp for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(prints, pa.int64())], ["doc_id", "mark", "fp"])

    return keyed(docs, id, text).mapInArrow(work, "doc_id long, mark long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: number of the bit left out, and the other bits of its segment."""
    keys = []
    for start, width in SEGMENTS:
        for bit in range(width):
            kept = ((1 << width) - 1) & ~(1 << bit)
            keys.append(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(kept)).bitwiseOR(F.lit((start + bit) << 22)))
    return F.array(*keys)


def _crowd(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the members as far as links of MOST bits do: from each member reached only to new ones."""
    found, left = [], members
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= MOST
            if near.any():
                new = left[near]
                found.append((np.full(len(new), x, np.uint64), new))
                front += list(new)
                left = left[~near]
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b["key"].to_numpy(), b["fp"].to_numpy()) for b in batches]
    if not parts:
        return
    key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order].view(np.uint64)  # signed numbers would have the bits of their magnitude counted
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    crowded = np.repeat(size > PAIRED, size)
    found = []
    for gap in range(1, min(PAIRED, int(size.max()))):
        near = (key[gap:] == key[:-gap]) & ~crowded[gap:]
        near &= np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= MOST
        found.append((fp[:-gap][near], fp[gap:][near]))
    for at, n in zip(first[size > PAIRED], size[size > PAIRED], strict=True):
        found += _crowd(np.unique(fp[at : at + n]))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: enough links between the distinct fingerprints `fp` (a scan) to connect all that MOST bits connect.

    A key with more than `crowd` fingerprints is cut into blocks and every two blocks meet in a task of their own.
    """
    rows = prints.count() * 64
    keyed = prints.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    counts = written(keyed.groupBy("key").count().where(F.col("count") > crowd))
    if not counts.isEmpty():
        blocks = F.ceil(F.col("count") / crowd).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
        spread = F.when(F.col("count").isNull(), F.array("key")).otherwise(meets)
        keyed = keyed.join(counts, "key", "left").select("fp", F.explode(spread).alias("key"))
    return keyed.repartition(max(1, -(-rows // ROWS)), "key").mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str, text: str, words: int = 4, crowd: int = CROWD) -> DataFrame:
    """doc_id, mark, fp, component_id (the smallest id among all documents reachable over links of MOST bits, itself
    included), root (a fingerprint that names the component).

    A null text has no words; documents without words have fingerprint 0. Repeated rows each give a row; a row without
    an id takes part with its fingerprint, and a component of such rows alone has a null component_id. An empty table
    gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, id, text, words))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), crowd))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(apart(least, "root"), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "mark", "fp", "component_id", "root")


def _distinct(text: str | None) -> np.ndarray:
    parts = list(shingles(text, SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _bands(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """A number for each band of MINIMA minima of the hashes in as many random orders, and a byte of each minimum."""
    if not len(hashes):
        return [], b""
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512] ^ MIXED[0]) * (MIXED[1] | np.uint64(1))).min(axis=1), out=least)
    digests = [xxhash.xxh3_64_digest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, MINIMA))]
    return np.frombuffer(b"".join(digests), "<i8").tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text in batch["text"]:
            own = _distinct(text.as_py())
            node = int(np.frombuffer(xxhash.xxh3_64_digest(own.tobytes()), "<i8")[0])
            fp = _majority(own[at : at + BLOCK] for at in range(0, len(own), BLOCK))
            out.append((node, len(own), fp, *_bands(own)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                         ["doc_id", "digest", "node", "n", "fp", "bands", "bytes"])


def _stars(batches: Iterator[pa.RecordBatch], share: float, many: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and order: pairs (b, one before it that it may be like, with that one's order).

    The first of a group takes those whose minima agree in AGREE places or more; of what is left the next takes its own,
    and so on. A member leaves when `many` took it, so with one, copies of one text cost a comparison of bytes each.
    """
    key, held = None, []

    def pairs() -> pa.RecordBatch:
        found: list[tuple] = []
        if len(held) > 1:
            marks = np.frombuffer(b"".join(h["bytes"] for h in held), np.uint8).reshape(len(held), -1)
            n = np.array([h["n"] for h in held])
            left, taken = np.arange(len(held)), np.zeros(len(held), int)
            while len(left) > 1:
                hub, left = left[0], left[1:]
                node = held[hub]["node"]
                like = ((marks[left] == marks[hub]).sum(axis=1) >= AGREE) & (np.minimum(n[left], n[hub]) >= share * np.maximum(n[left], n[hub]))
                if like.any():
                    like &= np.array([node not in held[i]["no"] for i in left])
                found += [(held[i]["node"], held[hub]["order"], node) for i in left[like]]
                taken[left] += like
                left = left[taken[left] < many]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["b", "order", "a"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["band"], row["block"]) != key:
                yield pairs()
                key, held = (row["band"], row["block"]), []
            held.append(row)
    yield pairs()


def _held(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part, the hub's text first: whether each other text has `share` or more of the union of its
    shingles and the hub's in common."""
    own = np.zeros(0, "<u8")
    for batch in batches:
        out: list[tuple] = []
        for hub, node, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text"], strict=True):
            said = _distinct(text.as_py())
            if node is None:
                own = said
                continue
            both = len(np.intersect1d(own, said, assume_unique=True))
            out.append((hub, node, both >= share * (len(own) + len(said) - both)))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "like"])


def similar(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], share: float = SHARE, block: int = HUBBED) -> DataFrame:
    """node: those whose shingles have a similarity of `share` or more to those of a node before them. No two nodes that
    are left, share a band and agree in AGREE minima are so similar.

    In the first round a member of shared bands meets one node before it, the first it may be like by its minima, and their
    shingles are compared. It goes if they are similar; if not, that pair is never taken again, and bands with such members
    go on; each further round lets a member meet four times as many. Bands with more than `block` members are dealt to blocks and go on while they shrink, then with larger blocks. A text
    is sent once a round; a hub's text goes to each task that compares some of its members. `texts` gives node and
    text of the nodes of a table.
    """
    spark = nodes.sparkSession
    memory = nodes.select("node", "order", "n", "bytes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    held = written(bands.join(apart(shared, "band"), "band").withColumn("no", F.array().cast("array<long>")))
    gone, many = spark.createDataFrame([], "node long"), 1
    while not held.isEmpty():
        dealt = held.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int"))
        rows = dealt.join(memory, "node").select("band", "block", "order", "node", "n", "bytes", "no")
        pairs = rows.repartition("band", "block").sortWithinPartitions("band", "block", "order").mapInArrow(
            lambda b, most=many: _stars(b, share, most), "b long, order string, a long")
        one = pairs.groupBy("b").agg(F.min(F.struct("order", "a")).alias("of")).select("b", "of.a")
        pairs = written(one if many == 1 else pairs.select("b", "a").distinct())
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).alias("parts"))
        met = pairs.join(apart(parts, "a"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
        own = texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        hubs = met.select("a", "part").distinct().join(own.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        others = met.join(own.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
        both = hubs.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        compared = written(both.mapInArrow(lambda b: _held(b, share), "a long, b long, like boolean"))
        new = compared.where("like").select(F.col("b").alias("node")).distinct()
        gone = gone.union(new)
        failed = compared.where("not like").groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("other"))
        left = held.join(new, "node", "left_anti").join(failed, "node", "left").select(
            "band", "node", F.when(F.col("other").isNull(), F.col("no")).otherwise(F.concat("no", "other")).alias("no"),
            F.col("other").isNotNull().alias("again"), F.col("size").alias("was"))
        left = written(left)
        sizes = left.groupBy("band").agg(F.count("*").alias("size"), F.max("again").alias("more"), F.max("was").alias("was"))
        wide = F.col("was") > block  # its blocks have not met each other yet
        sizes = written(sizes.where((F.col("size") > 1) & (F.col("more") | wide)))
        if not sizes.where(wide & (F.col("size") * 2 > F.col("was"))).isEmpty():
            block *= 16
        many *= 4
        held = written(left.select("band", "node", "no").join(apart(sizes.select("band", "size"), "band"), "band"))
    return gone


def grouped(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """node, group: nodes whose fingerprints `fp` are connected over links of MOST bits, named by their least fingerprint;
    nodes without such a link are a group of their own."""
    distinct = written(nodes.select("fp").distinct())
    roots = components(links(distinct, crowd)).withColumnRenamed("node", "fp")
    return nodes.select("node", "fp").join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("group"))


def representatives(docs: DataFrame, id: str, text: str, share: float = SHARE) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: those without a near-duplicate before them, in the order of
    ids, rows without one last. Of rows with the same shingles the first stays, of those that share its id the one with
    the smallest digest of the text, and of equal rows any one.

    Texts are near-duplicates if their sets of shingles of SHINGLE words have a similarity (Jaccard) of `share` or more.
    Candidates lie in one group of linked fingerprints (SimHash of the distinct shingles) or agree in one of BANDS bands of
    MINIMA minima, which at 0.8 are 0.9996 of the pairs and above it more, and all in AGREE minima of all, which at 0.8 all but one in a million do; no row goes without an exact comparison, but equal sets
    are told by a digest of 64 bits. A row may go for one that went itself. Texts without words are one text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = [F.col(id).cast("long").alias("doc_id"), F.md5(body.cast("binary")).alias("digest")]
    sketches = docs.select(*named, body.alias("text")).mapInArrow(_sketched, SKETCH)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    nodes = sketches.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("n", "fp", "bands", "bytes"))).select("node", "n", "fp", "bands", "bytes", "least.*")
    # text that sorts as the ids do, negative ones first, none last
    number = F.concat(F.when(F.col("doc_id") < 0, "0").otherwise("1"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    order = F.concat(F.coalesce(number, F.lit("2")), F.lit(":"), F.col("digest"), F.lit(":"), F.hex("node"))
    nodes = written(nodes.withColumn("order", order))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest")).alias("key")

    def texts(wanted: DataFrame) -> DataFrame:
        keys = nodes.join(wanted, "node", "left_semi").select("node", key)
        rows = docs.select(*named, body.alias("text")).select(key, "text").join(keys, "key")
        return written(rows.select("node", "text").dropDuplicates(["node"]))

    member = F.array(F.xxhash64(F.lit("fingerprints"), F.col("group")))
    candidates = written(nodes.join(grouped(nodes), "node").withColumn("bands", F.concat("bands", member)))
    chosen = nodes.select("node", "doc_id", "digest").join(similar(candidates, texts, share), "node", "left_anti").select(key)
    rows = docs.select(*named, F.struct(*docs.columns).alias("row")).select(key, "row")
    return rows.join(chosen, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
