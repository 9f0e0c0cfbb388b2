import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plyframe.llm import contraction, tries
from plyframe.llm.queries import prefix_trie
from plyframe.plans.scratch import written

TURNS = "conv_id long, turn long, role string, text string, depth string, node string, parent string"


def brute(rows):
    """The query's definition over (conv_id, turn, role, text)."""
    said = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            said.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()) for p, m in members.items()}


def found(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS).write.parquet(f"{folder}/conversations.parquet")
    got = prefix_trie(spark, folder).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_the_trie_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 8)
    monkeypatch.setattr(tries, "BLOCK_BITS", 1)
    rng = random.Random(11)
    rows = []
    for c in range(260):
        if c in (100, 137):  # one anchor is absent
            continue
        said = rng.choice(["ab", "abc", "x", "aaaa"])
        n = 1 if c == 200 else rng.randrange(1, 9)  # one anchor is shorter than most heads
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice([said, said, "é🙂", "", None])) for t in range(n)]
    rows += [(301, None, "user", "null turn first"), (301, 5, "user", "b"), (301, -1, "user", "a"), (None, 1, "user", "nobody")]
    rows += [(302, 1, "user", "same")] * 9
    rows += [(400 + i, t, "user", f"turn {t}") for i in range(40) for t in range(min(30, i + 1))]  # snapshots of one conversation
    rng.shuffle(rows)
    assert found(spark, tmp_path, rows) == brute(rows)


def test_a_long_conversation_and_many_copies(spark, tmp_path):
    rows = [(7, t, "user", f"{t}") for t in range(700)] + [(8, t, "user", f"{t}") for t in range(0, 690)]
    rows += [(1000 + c, 0, "user", "hello") for c in range(600)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_no_conversations(spark, tmp_path):
    assert found(spark, tmp_path, []) == set()
    (tmp_path / "b").mkdir()
    assert found(spark, tmp_path / "b", [(None, 1, "user", "a")]) == set()


@pytest.mark.parametrize("shape", ["random", "chain", "star", "caterpillar", "forest"])
def test_contraction_against_recursion(spark, shape):
    rng, n = random.Random(shape), 300
    up = {"random": lambda i: rng.randrange(i), "chain": lambda i: i - 1, "star": lambda i: 0,
          "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 7 == 0 else rng.randrange(i)}[shape]
    parent = {0: None} | {i: up(i) for i in range(1, n)}
    value = {i: rng.randrange(-5, 50) for i in parent}
    kids = {i: [k for k in parent if parent[k] == i] for i in parent}
    leaves, total = {}, dict(value)
    for i in reversed(range(n)):
        leaves[i] = sum(leaves[k] for k in kids[i]) or 1
        total[i] += sum(total[k] for k in kids[i])
    names = list(range(n))
    rng.shuffle(names)
    rows = [(names[i], None if p is None else names[p], value[i]) for i, p in parent.items()]
    tree = written(spark.createDataFrame(rows, "node long, parent long, value long").withColumn("kids", F.lit("extra")))
    got = {tuple(r) for r in contraction.subtree_totals(tree).collect()}
    assert got == {(names[i], len(kids[i]), leaves[i], total[i]) for i in parent}
