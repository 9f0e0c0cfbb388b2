import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plyframe.llm import packing, rendezvous
from plyframe.llm.queries import QUERIES
from plyframe.plans.scratch import written

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def gapless_from_zero(pairs):
    groups = defaultdict(list)
    for group, n in pairs:
        groups[group].append(n)
    return all(sorted(v) == list(range(len(v))) for v in groups.values())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = QUERIES["op2_rendezvous_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key" for r in rows)
    assert gapless_from_zero((r.shard, r.slot) for r in rows)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))


def test_weights_share_the_rows(spark):
    keys = spark.range(20_000)
    found = keys.select(rendezvous.shard_of(F.col("id"), [(0, 1.0), (1, 3.0), (2, 0.0)]).alias("s")).groupBy("s").count().collect()
    count = {r["s"]: r["count"] for r in found}
    assert set(count) == {0, 1} and 0.22 < count[0] / 20_000 < 0.28
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), [(0, 0.0)])


def test_placing_odd_rows(docs, empty):
    shards = [(s, 1.0) for s in range(3)]
    rows = rendezvous.place(docs, "doc_id", "text", shards, [*shards, (3, 1.0)]).collect()
    assert len(rows) == docs.count() and gapless_from_zero((r.shard, r.slot) for r in rows)
    assert {r.size for r in rows if r.key in (3, 4)} == {16}
    assert len({r.shard for r in rows if r.key == 7}) == 1
    assert rendezvous.place(empty, "doc_id", "text", shards, shards).count() == 0


def test_pieces_and_sequences_hold_every_id_once(docs, empty):
    pieces = written(packing.pieces(docs, "doc_id", "text", VOCABULARY).withColumn("row", F.monotonically_increasing_id()))
    rows = packing.pack(pieces, "length", "row").collect()
    own = Tokenizer.from_file(VOCABULARY)
    want = Counter(tuple(own.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for (doc, n), held in by_doc.items():
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in held), "<u4").tolist()
        assert len(ids) % n == 0, doc
    assert sum(len(k) * c for k, c in want.items()) == sum(r.length for r in rows)
    single = {d: v for d, v in by_doc.items() if d[0] not in (7, None)}
    assert all(tuple(np.frombuffer(b"".join(bytes(r.ids) for r in v), "<u4").tolist()) in want for v in single.values())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pieces(empty, "doc_id", "text", VOCABULARY).count() == 0


def test_words_encode_as_the_whole_text():
    own, encoder = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n ", "word", "Don't", "x'll", "12", "3.5", "é", "ß", "漢字", "🙂", "<|endoftext|>", " ", "!!", "\x00", "a" * 50, " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_patterns_use_the_histogram_and_pad_little():
    rng = random.Random(5)
    histogram = Counter(min(64, 1 + int(rng.expovariate(0.05))) for _ in range(20_000))
    found = packing.patterns(dict(histogram), 64)
    used = Counter()
    for count, held in found:
        assert sum(held) <= 64
        for n in held:
            used[n] += count
    assert used == histogram
    assert sum(n * c for n, c in histogram.items()) / (64 * sum(c for c, _ in found)) > 0.97
    assert packing.patterns({}, 64) == []


def test_lengths_out_of_range_are_refused(spark):
    rows = written(spark.createDataFrame([(0, 5), (1, 2000)], "row long, length long"))
    with pytest.raises(ValueError):
        packing.pack(rows, "length", "row")
