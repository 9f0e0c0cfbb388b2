import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plyframe.llm import bytescan, chunks, repeats
from plyframe.llm.induced import permuted_common_prefixes, suffix_array
from plyframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def without(texts, length):
    """By the definition: every byte of a string that starts elsewhere too."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(300):
        letters = int(rng.integers(2, 5))
        t = np.r_[rng.integers(1, letters, rng.integers(0, 60)), 0].astype(np.uint16)
        plain = t.tolist()
        sa = suffix_array(t, letters + 1)
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert sa.tolist() == want
        common = permuted_common_prefixes(t, sa)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while max(a, b) + n < len(plain) and plain[a + n] == plain[b + n]:
                n += 1
            assert common[b] == n


def test_query_by_definition(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = without([(r["text"] or "").encode() for r in rows], 200)
    got = QUERIES["op9_suffix_array_deduplication"](spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        (r["doc_id"], a, b, c, hashlib.sha256(k).hexdigest()) for r, (a, b, c, k) in zip(rows, want, strict=True)}


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_shared_passages_by_definition(spark, crowd):
    """Copies, near copies and passages in many documents, and names that must be divided."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage, base = " ".join(word() for _ in range(70)), [word() for _ in range(150)]
    texts = []
    for k in range(40):
        if k % 4 == 0:
            body = " ".join(word() for _ in range(60)) + passage + " ".join(word() for _ in range(60))
        elif k % 4 == 1:
            edited = list(base)
            edited[rng.randrange(150)] = word()
            body = " ".join(edited)
        elif k % 4 == 2:
            body = "ab c " * rng.randrange(300)
        else:
            body = " ".join(word() for _ in range(rng.randrange(80)))
        texts.append(body)
    texts += texts[:2]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(table, "doc_id", "text", crowd=crowd).collect()}
    want = without([t.encode() for t in texts], 200)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_in_odd_rows(docs, empty):
    rows = repeats.without_repeats(docs, "doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == Counter(without(texts, 200))
    assert repeats.without_repeats(empty, "doc_id", "text").count() == 0


def test_rewriting_keeps_rows_and_columns(docs):
    new = bytescan.rewritten(docs, "doc_id", "text", repeats.repeated_spans(docs, "doc_id", "text"))
    assert new.columns == docs.columns and new.count() == docs.count()
    assert {r.text for r in new.where("doc_id = 3").collect()} == {None}
    assert {r.text for r in new.where("doc_id IN (1, 2, 7)").collect()} == {""}


def chunked(text):
    gap = chunks.WINDOW + chunks.REACH
    data = np.frombuffer(bytes(gap) + text + bytes(gap), np.uint8)
    return {int(e) - gap for e in chunks.boundaries(data) if gap < e < gap + len(text)}


def test_an_insertion_moves_only_near_boundaries():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2000)).encode()
    before, after = chunked(text), chunked(text[:5000] + b"inserted words" + text[5000:])
    far = chunks.WINDOW + chunks.REACH
    assert {e for e in before if e < 5000 - far} == {e for e in after if e < 5000 - far}
    assert {e for e in before if e > 5000 + far} == {e - 14 for e in after if e > 5014 + far}
    assert 100 < len(before) < 400


def test_chunks_keep_the_first_copy_only(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = text(60)
    rows = [(3, text(50) + passage + text(50)), (1, text(80) + passage + text(10)), (2, text(100)), (4, passage), (5, passage)]
    got = {r.doc_id: r for r in chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 0
    assert got[3].n_removed > 100 and got[4].n_removed > 100 and len(got[5].kept) == 0
    for i, body in rows:
        assert len(got[i].kept) == len(body) - got[i].n_removed


def plain_chunks(text):
    """Chunks by the definition: a byte's hash is the sum of the 32 gears up to it, each shifted by its distance."""
    gear, pad = chunks.GEAR.tolist(), chunks.WINDOW + chunks.REACH
    data = bytes(pad) + text + bytes(pad)
    h = [sum(gear[data[i - j]] << j for j in range(32)) % 2**32 if i >= 31 else 0 for i in range(len(data))]
    ends = [i + 1 - pad for i in range(pad, pad + len(text)) if h[i] > max(h[i - 32 : i] + h[i + 1 : i + 33])]
    out, at = [], 0
    for end in [*(e for e in ends if 32 <= e <= len(text) - 32 and text[e] & 0xC0 != 0x80), len(text)]:
        if end > at:
            out.append((at, end))
        at = end
    return out


def test_chunks_by_definition(spark):
    """Whole results against chunks and owners found plainly, with repeated and missing ids."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    parts = [text(n) for n in (5, 12, 30, 60, 90)]
    rows = [(rng.choice([None, 1, 2, *range(3, 40)]), " ".join(rng.choice(parts) if rng.random() < 0.4 else text(20) for _ in range(rng.randrange(0, 6)))) for _ in range(80)]
    rows += [rows[0], (None, parts[1]), (7, parts[1])]

    def order(row):
        digest = hashlib.md5(row[1].encode()).hexdigest()
        return (row[0] is None, row[0] or 0, int(digest[:15], 16), int(digest[15:30], 16))

    owner = {}
    for row in sorted(set(rows), key=order):
        body = row[1].encode()
        for a, b in plain_chunks(body):
            owner.setdefault(body[a:b], (row, a))
    want = Counter()
    for row in rows:
        body = row[1].encode()
        cuts = [{"at": [a], "runs": [{"first": 0, "size": b - a}]} for a, b in plain_chunks(body) if b - a >= 32 and owner[body[a:b]] != (row, a)]
        want[row[0], *bytescan._cut(body, cuts, chunks.PASSAGE)] += 1
    got = chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert sum(r.n_removed > 0 for r in got) > 20 and sum(r.n_removed == 0 for r in got) > 20


def test_rows_are_told_apart_by_more_than_a_short_hash(spark):
    """Two texts that Spark's 32-bit hash does not tell apart, both without an id: the one that occurs once stays."""
    texts = spark.range(200_000).select(F.concat(*(F.sha2(F.concat("id", F.lit(f":{i}")), 256) for i in range(6))).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).where("n > 1").orderBy("a").first()
    rows = spark.createDataFrame([(None, pair.a), (None, pair.b), (1, pair.a)], "doc_id long, text string")
    for found, gone in ((repeats.without_repeats(rows, "doc_id", "text"), [0, 384, 384]), (chunks.deduplicated(rows, "doc_id", "text"), [0, 0, 384])):
        assert sorted(r.n_removed for r in found.collect()) == gone


def test_runs_of_spans():
    body, at = bytes(range(100)), lambda *spans: [{"at": [a], "runs": [{"first": 0, "size": n}]} for a, n in spans]
    assert bytescan._cut(body, None) == (100, 0, 0, body)
    assert bytescan._cut(body, at((10, 5), (15, 5), (12, 2), (50, 3)))[:3] == (100, 13, 2)
    assert bytescan._cut(body, at((10, 5), (15, 5), (50, 3)), 10) == (100, 10, 1, body[:10] + body[20:])
    assert bytescan._cut(body, at((0, 60), (60, 40)), 200) == (100, 100, 1, b"")


def test_chunks_of_odd_rows(docs, empty):
    rows = chunks.deduplicated(docs, "doc_id", "text").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert len(r.kept) == r.n_bytes - r.n_removed
        bytes(r.kept).decode()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_removed < by[1].n_bytes and len(by[2].kept) == 0
    assert by[3].n_bytes == by[4].n_bytes == 0
    assert len({r.n_removed for r in rows if r.doc_id == 7}) == 1 and by[8].n_removed > 30_000
    assert chunks.deduplicated(empty, "doc_id", "text").count() == 0
