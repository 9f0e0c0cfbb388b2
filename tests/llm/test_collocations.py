import random
import re
from collections import Counter

import numpy as np
import pytest

from plyframe.llm import collocations


def brute(rows, top=2000, least=10, most=3):
    said, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                said.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    often = {k: a for k, a in said.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), f in often.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
              if j - i < len(w) and 100 * f >= 50 * said[lang, w[i:j]]}
    out = []
    for (lang, w), a in often.items():
        if (lang, w) in inside:
            continue
        cuts = [(1_000_000 * a * a // (said[lang, w[:k]] * said[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), said[lang, w[:k]], said[lang, w[k:]]))
    found, rank = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


def texts(seed, n, words):
    rng = random.Random(seed)
    known = [f"W{i}" for i in range(words)] + ["é", "漢字", "\x1cx", "\x00", "New", "york", "City", "new"]
    fixed = ["new York city", "a b c d", "x x x x x", "of the of the"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else known[int(len(known) * rng.random() ** 3)] for _ in range(rng.randrange(120))]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(p + rng.choice(glue) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, "."), ("en", "new york city " * 400), ("fr", "un deux " * 30)]


@pytest.mark.parametrize("tile,dense,hold,span", [(512, 8192, 1 << 19, 1 << 20), (4, 3, 500, 64), (4, 1, 100, 1)])
def test_against_brute_force(spark, monkeypatch, tile, dense, hold, span):
    for name, value in (("TILE", tile), ("DENSE", dense), ("HOLD", hold), ("SPAN", span)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts(tile, 150, 60)
    table = spark.createDataFrame([(*r, "", "", "") for r in rows], "lang string, text string, id string, f string, batch string")
    got = {tuple(r) for r in collocations.collocations(table.repartition(5), "text", "lang").collect()}
    assert got == brute(rows)
    assert len({p for _, _, p, *_ in got if len(p.split(" ")) == 3}) > 1


def test_limits_and_longer_phrases(spark):
    rows = texts(1, 80, 20)
    table = spark.createDataFrame(rows, "lang string, text string")
    for options in ({"top": 3}, {"least": 4, "most": 4}, {"most": 2}):
        got = {tuple(r) for r in collocations.collocations(table, "text", "lang", **options).collect()}
        assert got == brute(rows, **options)


def test_no_texts(spark):
    table = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(table, "text", "lang").count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", " . ")], "lang string, text string"), "text", "lang").count() == 0


def test_pairs_are_numbered_in_text_order(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    monkeypatch.setattr(collocations, "DENSE", 20)
    rng = np.random.default_rng(2)
    seq = (rng.random(5000) ** 3 * 300).astype(np.int64) - 1
    ids = rng.permutation(300).astype(np.int64) * (1 << 33)
    ids[:200] = np.arange(200)
    ids[rng.random(300) < 0.1] = -1
    out, left, right, times = collocations.adjacent(seq, ids)
    want = [(ids[a], ids[b]) if a >= 0 and b >= 0 and ids[a] >= 0 and ids[b] >= 0 else None for a, b in zip(seq[:-1], seq[1:], strict=True)]
    assert [None if i < 0 else (left[i], right[i]) for i in out] == want
    assert Counter(w for w in want if w) == {(a, b): t for a, b, t in zip(left, right, times, strict=True)}


def test_pairs_of_a_batch_are_a_packed_row_for_a_shard():
    rng = np.random.default_rng(3)
    for top in (0, 1, 255, 256, 1 << 40):
        a = rng.integers(0, top + 1, 100)
        assert (collocations.unpack(collocations.pack(a)) == a).all()
    assert len(collocations.unpack(collocations.pack(np.zeros(0, np.int64)))) == 0
    left, right = (rng.random((2, 40000)) ** 3 * 5000).astype(np.int64)
    order, starts = collocations._dealt(left, right, 8)
    assert sorted(order) == list(range(40000)) and starts[0] == 0 and starts[-1] == 40000
    at = [order[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
    pairs = [set(zip(left[i], right[i], strict=True)) for i in at]
    assert len(set().union(*pairs)) == sum(map(len, pairs))
    size = sum(len(collocations.pack(np.diff(left[i], prepend=0))) + len(collocations.pack(right[i])) for i in at)
    assert all((np.diff(left[i]) >= 0).all() for i in at) and size < 4 * 40000
