import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn. " * 6),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn. " * 6),
    (3, None),
    (4, ""),
    (5, "word"),
    (6, "äöü ß 漢字 emoji 🙂 " * 40),
    (7, "aaaa " * 3000),
    (7, "aaaa " * 3000),
    (8, "x" * 40_000),
    (None, "a row without an id but with some words in it, enough to make shingles"),
    (9, "one two  three\n\n\tfour   five \x00 six<|endoftext|> seven"),
    (10, "Several words that differ from all others " + " ".join(f"w{i * 7919 % 1000}" for i in range(900))),
    (11, "Several words that differ from all others " + " ".join(f"w{i * 7919 % 1000}" for i in range(899)) + " other"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, an empty text, ties, repeated rows, long texts, and columns whose names the operators use themselves."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    clash = ["mark", "fp", "key", "name", "digest", "n", "m", "row", "cuts", "start", "stop", "shard", "slot", "length", "score", "window"]
    return rows.withColumns({c: F.lit(f"extra {c}") for c in clash})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
