"""A document quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by its byte and word habits and encoded by a learned layer;
gated attention, learned from document labels alone, weighs the encoded passages, and the weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 96
CLASSES = 16
FEATURES = CLASSES * CLASSES + 5
SPAN = 1 << 20
SAMPLE = 2000
PASSAGES = 256


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, blanks, marks by kind, bytes of longer characters."""
    table = np.full(256, 10, np.uint8)
    table[: ord(" ")] = 14
    for number, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
                                    ".", ",", "!?", "|", "#$%&*", None, None, None, "'\"", None, "()[]{}<>"]):
        for c in chars or "":
            table[ord(c)] = number
    table[128:192], table[192:] = 12, 11
    return table


TABLE = _classes()
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(256)], np.uint64)


def features(text: bytes) -> np.ndarray:
    """A row for each passage of WORDS words: root frequencies of pairs of byte classes; shares of words that repeat
    the one before or an earlier one of the passage; length of words, of the passage, and longest word."""
    b = np.frombuffer(text, np.uint8)
    blank = BLANK[b]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(start):
        return np.zeros((1, FEATURES), np.float32)
    word = np.cumsum(~blank & np.r_[True, blank[:-1]]) - 1
    word[word < 0] = 0
    passage = word // WORDS
    n = int(passage[-1]) + 1
    kind = TABLE[b].astype(np.int64)
    pair = passage[1:] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    counts = np.bincount(pair, minlength=n * CLASSES * CLASSES)[: n * CLASSES * CLASSES].reshape(n, -1)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :-5] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    size = np.add.reduceat((~blank).astype(np.int64), start)
    place = np.minimum(np.arange(len(b)) - start[word], 255)
    value = np.where(blank, np.uint64(0), b.astype(np.uint64) + np.uint64(1)) * POWERS[np.maximum(place, 0)]
    value = np.add.reduceat(value, start)
    of = np.arange(len(start)) // WORDS
    words = np.bincount(of, minlength=n)
    again = np.r_[False, (value[1:] == value[:-1]) & (of[1:] == of[:-1])]
    order = np.lexsort((value, of))
    seen = np.r_[False, (value[order][1:] == value[order][:-1]) & (of[order][1:] == of[order][:-1])]
    out[:, -5] = np.bincount(of, again, minlength=n) / words
    out[:, -4] = np.bincount(of[order], seen, minlength=n) / words
    out[:, -3] = np.log1p(np.bincount(of, size, minlength=n) / words) / 3
    out[:, -2] = np.log1p(words) / np.log1p(WORDS)
    out[:, -1] = np.log1p(np.maximum.reduceat(size, np.arange(0, len(start), WORDS))) / 6
    return out


def spans(text: bytes) -> Iterator[bytes]:
    """The text in parts of about SPAN bytes cut at blanks, which bounds the memory that one document takes."""
    at = 0
    while len(text) - at > SPAN:
        cut = max(text.rfind(b" ", at + 1, at + SPAN), text.rfind(b"\n", at + 1, at + SPAN))
        cut = cut if cut > at else at + SPAN
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    """Encoder (w, b), attention (v, u, a), head (c, d)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w + self.b)

    def attention(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        return t, g, (t * g) @ self.a

    def score(self, h: np.ndarray) -> float:
        """Of one document from its encoded passages."""
        weight = self.attention(h)[2]
        weight = np.exp(weight - weight.max())
        return float(_sigmoid((weight / weight.sum()) @ h @ self.c + self.d)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, hidden: int = 24, gates: int = 12,
          epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit by Adam on the weighted cross-entropy of document labels; one class or no document gives a constant score."""
    rng = np.random.default_rng(seed)
    shape = {"w": (FEATURES, hidden), "b": (hidden,), "v": (hidden, gates), "u": (hidden, gates), "a": (gates,), "c": (hidden, 1), "d": (1,)}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float64) for k, s in shape.items()}
    if len(set(labels.tolist())) < 2:
        p["c"][:], p["d"][:] = 0, 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return Model(**p)
    first, second, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    weights = weights / weights.mean()
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            chosen = order[at : at + batch]
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            n = np.array([len(bags[i]) for i in chosen])
            begin, bag = np.r_[0, np.cumsum(n)[:-1]], np.repeat(np.arange(len(n)), n)
            m = Model(**p)
            h = m.encoded(x)
            t, g, e = m.attention(h)
            share = np.exp(e - np.maximum.reduceat(e, begin)[bag])
            share /= np.add.reduceat(share, begin)[bag]
            z = np.add.reduceat(share[:, None] * h, begin)
            y = _sigmoid(z @ m.c + m.d)[:, 0]
            delta = ((y - labels[chosen]) * weights[chosen] / len(chosen))[:, None]
            dz = delta @ m.c.T
            ds = (dz[bag] * h).sum(axis=1)
            de = share * (ds - np.add.reduceat(share * ds, begin)[bag])
            dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
            dh = (share[:, None] * dz[bag] + dt @ m.v.T + dg @ m.u.T) * (1 - h * h)
            grad = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ delta, "d": delta.sum(axis=0)}
            step += 1
            for k, q in grad.items():
                q = q + 1e-4 * p[k]
                first[k] += 0.1 * (q - first[k])
                second[k] += 0.001 * (q * q - second[k])
                p[k] = p[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(**p)


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """Fit on at most `sample` labelled documents of each class, chosen by the hash of their id and weighted by the
    size of their class. Documents with conflicting, missing or other labels than 0 and 1 are not used. Of rows that
    repeat an id the least text is used, and of a text at most `passages` passages, evenly spread over all of it: so the
    driver gets at most 2 x `sample` x `passages` rows of features. Scoring has no such bounds."""
    known = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 x sample rows at most
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = (np.concatenate([features(s) for s in spans((x or "").encode("utf-8", "replace"))]) for x in batch["text"].to_pylist())
            rows = [b[np.unique(np.linspace(0, len(b) - 1, passages).astype(int))].astype(np.float16).tobytes() for b in bags]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    rows = source.mapInArrow(work, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], len(r["x"])))
    y = np.array([r["y"] for r in rows], float)
    used = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in rows]
    return train(bags, y, np.array([sizes[int(k)] / used[int(k)] for k in y]))


def _score(model: Model, text: str | None) -> float:
    return model.score(np.concatenate([model.encoded(features(s)) for s in spans((text or "").encode("utf-8", "replace"))]))


def accepted(docs: DataFrame, model: Model, text: str, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose whole text scores `least` or more."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_score(model, x.as_py()) >= least for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def scored(docs: DataFrame, model: Model, id: str, text: str) -> DataFrame:
    """doc_id, score for every row and its whole text. A null text is empty; an empty one is one passage without words.
    Nothing is shuffled; the model is a few thousand numbers, whatever the data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [_score(model, x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, score double")
