import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from plyframe.llm import fertility
from plyframe.llm.queries import fertility_query

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
SF = "/root/testdata/sf0.001"


def counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    earlier, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            again += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), words


def naive(text):
    *base, words = counts(text)
    parts = [w[i : i + fertility.PART] for w in words for i in range(0, len(w), fertility.PART)]
    if not words:
        return (*base, 0, None, None, None)
    tokens = sum(len(BYTES.encode(" " + p, add_special_tokens=False).ids) for p in parts)
    pieces = Counter(i for p in parts for i in MODEL.encode(p))
    n = sum(pieces.values())
    bare = sum(c for i, c in pieces.items() if MODEL.is_byte(i))
    return (*base, tokens, round(base[1] / tokens, 3), round(bare / n, 4), -sum(c / n * math.log2(c / n) for c in pieces.values()))


def same(got, want):
    return got[:-1] == want[:-1] and (got[-1] is want[-1] or abs(got[-1] - want[-1]) < 1e-3)


def test_measures_against_their_definition():
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "a", "a b", "word", "Don't", "x#*$", "12", "é", "漢字", "🙂", "<|endoftext|>", " ", "w" * 120, "ab\n", "ab\n"]
    texts = ["", " ", "a a a a", "a b c\na b c", "x" * 5000, *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400))]
    got = fertility.measures(texts, fertility.Vocabulary(RANKS, PIECES))
    for text, own in zip(texts, got, strict=True):
        assert same(own[1:], naive(text)), (text, own, naive(text))
    assert [fertility.script(t) for t in ("abc где", "где a", "漢字", "123", "")] == ["latin", "cyrillic", "han", "other", "other"]


def quartiles(values):
    return np.quantile(values, [0.25, 0.75])


def test_the_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in fertility_query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs)
    own = {r.doc_id: naive(r.text) for r in docs}
    failed = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, m in own.items()}
    limits = {}
    for lang in {r.lang for r in docs}:
        good = [rows[r.doc_id] for r in docs if r.lang == lang and not failed[r.doc_id]]
        for m, (times, least) in fertility.FENCES.items():
            low, high = quartiles([r[m] for r in good])
            margin = max((high - low) * times, least)
            limits[lang, m] = low - margin - 1e-12, high + margin + 1e-12
    for r in docs:
        row = rows[r.doc_id]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy")
        assert same(tuple(row[c] for c in names), own[r.doc_id])
        assert row.base_failed == failed[r.doc_id]
        inside = not failed[r.doc_id] and all(limits[r.lang, m][0] <= row[m] <= limits[r.lang, m][1] for m in fertility.FENCES)
        assert row.kept == inside


def test_good_documents_stay_and_odd_ones_go(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in fertility_query(spark, "/root/testdata/sf0.01").collect() if not r.base_failed and r.doc_id in labels]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.5


def test_bytes_no_piece_covers_are_rejected(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("the cat sat on a mat with some other animals while rain fell outside and nobody came home".split()) for _ in range(80)) for _ in range(60)]
    runes = "".join(chr(0x16A0 + i % 70) + (" " if i % 5 == 0 else "") for i in range(600))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(100, runes, "en"), (101, prose[0], None), (102, " ".join(f"{rng.random():.15f}" for _ in range(80)), "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.ruled(table, "doc_id", "text", "lang", RANKS, PIECES).collect()}
    assert not kept[100] and not kept[102] and kept[101] and sum(kept[i] for i in range(60)) >= 58


def test_odd_rows(docs, empty):
    odd = docs.withColumn("lang", F.when(F.col("doc_id") < 7, "en"))
    rows = fertility.ruled(odd, "doc_id", "text", "lang", RANKS, PIECES).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r for r in rows}
    assert texts[3].n_words == texts[4].n_words == 0 and texts[3].base_failed and texts[3].entropy is None
    assert texts[8].n_words == 1 and texts[8].word_chars == 40_000 and not texts[8].kept
    assert fertility.ruled(empty.withColumn("lang", F.lit("x")), "doc_id", "text", "lang", RANKS, PIECES).count() == 0


@pytest.mark.parametrize("ids,want", [([], 0), ([1, 2, 3], 0), ([1, 1, 1, 1], 4), ([1, 2, 3, 1, 2, 3], 6), ([1, 2, 3, 9, 1, 2, 3], 6)])
def test_repeated_windows(ids, want):
    assert fertility.repeated(np.array(ids, np.int64)) == want
