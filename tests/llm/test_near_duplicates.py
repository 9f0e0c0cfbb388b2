import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from plyframe.llm import simhash
from plyframe.llm.components import components
from plyframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    """By the definition, one shingle and one bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Smallest id reachable, over all pairs."""
    least = dict.fromkeys(prints)
    for start in sorted(prints, key=lambda i: (i is None, i)):
        if least[start] is None:
            front, least[start] = [start], start
            while front:
                x = front.pop()
                for y in prints:
                    if least[y] is None and (prints[x] ^ prints[y]).bit_count() <= 4:
                        least[y] = start
                        front.append(y)
    return least


def test_query_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = groups(prints)
    got = QUERIES["op6_simhash_near_duplicates"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}


def clustered(rng, centres, near, most):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(near):
            x = c
            for b in rng.sample(range(64), rng.randrange(most + 1)):
                x ^= 1 << b
            out.add(x)
    return out


def check_links(spark, prints, crowd):
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    table = spark.createDataFrame(signed, "fp long")
    root = {r.node: r.root for r in components(simhash.links(table, crowd)).collect()}
    by_root = defaultdict(set)
    for (x,) in signed:
        by_root[root.get(x, x)].add(x & ((1 << 64) - 1))
    want = groups({x: x for x in prints})
    expected = defaultdict(set)
    for x, r in want.items():
        expected[r].add(x)
    assert {frozenset(v) for v in by_root.values()} == {frozenset(v) for v in expected.values()}


def test_links_lose_none_in_sparse_and_crowded_keys(spark):
    rng = random.Random(11)
    check_links(spark, clustered(rng, 30, 12, 5), simhash.CROWD)
    check_links(spark, clustered(rng, 2, 150, 6), simhash.CROWD)


def test_crowded_keys_are_cut_into_blocks(spark):
    check_links(spark, clustered(random.Random(12), 3, 60, 6), 7)


def test_crowd_connects_what_all_pairs_connect():
    rng = random.Random(13)
    members = np.array(sorted(clustered(rng, 3, 80, 5)), np.uint64)
    parent = {int(x): int(x) for x in members}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash._crowd(members):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4
            parent[top(x)] = top(y)
    want = groups({int(x): int(x) for x in members})
    assert all((want[a] == want[b]) == (top(a) == top(b)) for a in parent for b in parent)


def test_odd_rows(docs, empty):
    rows = simhash.near_duplicates(docs, "doc_id", "text").collect()
    assert len(rows) == docs.count()
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id].add((r.fp, r.component_id))
    assert found[3] == found[4] == {(0, 3)}
    assert found[1] | found[2] == {(next(iter(found[1]))[0], 1)}
    assert len(found[7]) == 1 and {c for _, c in found[None]} == {None}
    assert {c for _, c in found[10] | found[11]} == {10}
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0


def test_one_representative_stays(docs, empty):
    kept = simhash.representatives(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 5, 6, 7, 8, None, 9, 10], key=str)
    assert simhash.representatives(empty, "doc_id", "text").count() == 0


def copies(rng, similarity, words=400):
    """A text and a copy of about that similarity of shingles of five words: separate words are replaced."""
    said = [f"w{rng.getrandbits(40)}" for _ in range(words)]
    other, most = list(said), round((words - 4) * (1 - similarity) / (1 + similarity) / 5)
    for at in rng.sample(range(1, words // 6 - 1), most):
        other[6 * at] = f"x{rng.getrandbits(40)}"
    return " ".join(said), " ".join(other)


def jaccard(a, b):
    a, b = (({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for t in (a, b))
    return len(a & b) / len(a | b)


def shingle_set(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_copies_of_similarity_from_080_go_and_others_stay(spark):
    rng = random.Random(17)
    pairs = [copies(rng, s) for s in (0.95, 0.9, 0.85, 0.82, 0.78, 0.7, 0.5) for _ in range(12)]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    near = [jaccard(*p) >= 0.8 for p in pairs]
    assert 40 <= sum(near) <= 60
    assert kept == {2 * i + k for i, p in enumerate(pairs) for k in (0, 1) if not (k and near[i])}


@pytest.mark.parametrize("block", [3, 4096])
def test_crowded_bands_keep_no_similar_texts(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.similar, "__defaults__", (simhash.SHARE, block))
    monkeypatch.setattr(simhash, "COMPARED", 4)
    rng = random.Random(18)
    said = [[f"w{rng.getrandbits(40)}" for _ in range(120)] for _ in range(2)]
    said[1][:105] = said[0][:105]  # two families, each similar in itself
    texts = [" ".join(x if i != 6 + 6 * (k % 15) else f"y{k}" for i, x in enumerate(s)) for s in said for k in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.representatives(table, "doc_id", "text").collect())
    assert kept[0] == 0
    assert all(jaccard(texts[a], texts[b]) < 0.8 for a in kept for b in kept if a < b)
    assert all(any(jaccard(texts[a], texts[b]) >= 0.8 for a in range(b)) for b in range(len(texts)) if b not in kept)


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Near copies go by their linked fingerprints alone, without any band of minima; an exact comparison still follows."""
    sketched = simhash._sketched
    monkeypatch.setattr(simhash, "_sketched", lambda batches: (
        pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([[]] * len(b), pa.list_(pa.int64())), b["bytes"]], b.schema.names) for b in sketched(batches)))
    rng = random.Random(19)
    said = [[f"w{rng.getrandbits(40)}" for _ in range(2_000)] for _ in range(4)]
    rows = [(2 * i + k, " ".join(x if k == 0 or at != 1_000 else "other" for at, x in enumerate(s))) for i, s in enumerate(said) for k in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash._majority([simhash._distinct(t)]) & (1 << 64) - 1 for _, t in rows]
    assert all((prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= 4 for i in range(4))
    assert {r.doc_id for r in simhash.representatives(table, "doc_id", "text").collect()} == {0, 2, 4, 6}
