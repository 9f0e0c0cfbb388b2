"""Quality rules on how public vocabularies cut a text.

A text that a vocabulary was made for is cut into few, varied tokens. Three measures of a text's words tell others:
characters per token, the share of tokens that are single bytes no piece covers, and the entropy of the tokens. Each has a
band per language (or script, where the language is null), fitted on the documents of that language, and a document
outside one of them is rejected. Rules on counts of words, lines and repeats come with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.plans.scratch import written

WORD = re.compile(r"[^\x20\x09-\x0D]")
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
PART = 48
SPAN = 16 << 20  # bytes of text whose words are cut together
CACHED = 400_000
# per measure: fences around the quartiles in quartile distances, and the least distance of a fence from its quartile
FENCES = {"chars_per_token": (2.0, 0.1), "byte_share": (3.0, 0.05), "entropy": (3.0, 0.5)}
LEAST = 50
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF),
           "arabic": (0x600, 0x6FF), "indic": (0x900, 0xDFF), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF),
           "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURED = f"doc_id long, lang string, script string, {BASE}, n_tokens long, chars_per_token double, byte_share double, entropy double"


class Vocabulary:
    """How public vocabularies cut words: tokens of the byte-level one, pieces of the other, bare bytes among these.

    A word is cut as if a space stood before it, and into parts of PART characters first, so that its cost is linear. What a
    part is cut into is remembered up to a bound.
    """

    def __init__(self, ranks: str, pieces: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bare = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[str, tuple[int, list[int]]] = {}

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the number of tokens, the number of pieces, and all their pieces in a row."""
        if len(self.known) > CACHED:
            self.known.clear()
        long = {w: [w[i : i + PART] for i in range(0, len(w), PART)] for w in words if len(w) > PART}
        new = list({p for own in ([w for w in words if w not in long], *long.values()) for p in own if p not in self.known})
        tokens = map(len, map(self.bytes.encode_ordinary, [" " + p for p in new]))
        self.known.update(zip(new, zip(tokens, self.pieces.encode(new, num_threads=1), strict=True), strict=True))
        whole = {w: (sum(self.known[p][0] for p in own), [i for p in own for i in self.known[p][1]]) for w, own in long.items()}
        found = [whole[w] if w in whole else self.known[w] for w in words] if whole else list(map(self.known.__getitem__, words))
        tokens, pieces = list(zip(*found, strict=True)) or ((), ())
        return np.array(tokens, np.int64), np.array(list(map(len, pieces)), np.int64), np.array(list(chain.from_iterable(pieces)), np.int32)


def script(text: str) -> str:
    """The script of most letters among SCRIPTS, the first on a tie; 'other' without any."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = {s: int(((codes >= a) & (codes <= b)).sum()) for s, (a, b) in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated(ids: np.ndarray) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1].astype(np.int64) << 32 | ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def measures(texts: list[str], vocabulary: Vocabulary) -> list[tuple]:
    """Counts and measures of texts; a text without words has null measures."""
    ids: dict[str, int] = {}
    said = [np.array([ids.setdefault(w, len(ids)) for w in t.encode("utf-8", "replace").split()], np.int64) for t in texts]
    n_tokens, n_pieces, pieces = vocabulary.cut([w.decode() for w in ids])
    starts = np.cumsum(n_pieces) - n_pieces
    rows = []
    for text, order in zip(texts, said, strict=True):
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = len(text) - sum(map(text.count, BLANKS))
        counts = (script(text), len(order), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(order))
        if not len(order):
            rows.append((*counts, 0, None, None, None))
            continue
        words, times = np.unique(order, return_counts=True)
        tokens, each = int(n_tokens[words] @ times), n_pieces[words]
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        seen = np.bincount(pieces[np.repeat(starts[words], each) + within], np.repeat(times, each), len(vocabulary.bare))
        share = seen[seen > 0] / seen.sum()
        entropy = -float((share * np.log2(share)).sum()) + 0.0
        rows.append((*counts, tokens, round(chars / tokens, 3), round(float(seen[vocabulary.bare].sum() / seen.sum()), 4), round(entropy, 3)))
    return rows


def measured(docs: DataFrame, id: str, text: str, lang: str, ranks: str, pieces: str) -> DataFrame:
    """doc_id, lang, script, counts and measures of every row; whole texts, a null text has no words.

    `ranks` and `pieces` are the paths of a byte-level vocabulary for `tiktoken` and of a `sentencepiece` model.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in MEASURED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(ranks, pieces)
        for batch in batches:
            step = max(1, batch.num_rows * SPAN // max(1, batch["text"].nbytes))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                rows = measures([t or "" for t in some["text"].to_pylist()], vocabulary)
                made = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["lang"], *made], [n for n, _ in fields])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, MEASURED)


def group() -> Column:
    """The language, or the script where that is null, in a namespace of its own."""
    return F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in windows of three words that repeat."""
    return (F.col("n_words") < LEAST) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def bands(rows: DataFrame) -> DataFrame:
    """band, and low and high of each measure: the quartiles of the language's documents that pass the base rules, widened
    by FENCES.

    Measures are rounded, so a language has a bounded number of values: these are counted first and quartiles are exact.
    At most a quarter of a language's documents on one side can be odd without moving its band past the others.
    """
    good = rows.where(~base_failed()).withColumn("band", group())
    stacked = good.select("band", F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in FENCES))).alias("of")).select("band", "of.*")
    counts = stacked.groupBy("band", "measure", "value").count()
    quartiles = counts.groupBy("band", "measure").agg(F.expr("percentile(value, array(0.25D, 0.75D), `count`)").alias("q"))
    picked = [F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in FENCES]
    wide = quartiles.groupBy("band").agg(*picked)
    fences = []
    for m, (times, least) in FENCES.items():
        margin = F.greatest((F.col(m)[1] - F.col(m)[0]) * times, F.lit(least))
        fences += [(F.col(m)[0] - margin).alias(f"low_{m}"), (F.col(m)[1] + margin).alias(f"high_{m}")]
    return wide.select("band", *fences)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with base_failed and kept: false for those that fail the base rules or leave a band of their language.

    Languages without a band have no document that passes the base rules, so nothing of theirs is kept.
    """
    inside = F.lit(True)
    for m in FENCES:
        inside = inside & F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    found = rows.withColumn("band", group()).join(limits, "band", "left")
    return found.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.coalesce(inside, F.lit(False))}).drop("band")


def ruled(docs: DataFrame, id: str, text: str, lang: str, ranks: str, pieces: str) -> DataFrame:
    """Every row of `docs` by id with its counts, measures, bands, base_failed and kept.

    Repeated rows and rows without an id are documents of their own; a null or empty text fails the base rules. Other
    columns are not read. An empty table gives no rows.
    """
    rows = written(measured(docs, id, text, lang, ranks, pieces))
    return judged(rows, written(bands(rows)))
