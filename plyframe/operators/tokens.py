"""Fixed-length token columns.

A word vocabulary counted by Spark stands in for the neural tokenizer. A real tokenizer is plugged
in with `encode_with`, which hands it Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written

PAD, UNKNOWN = 0, 1
FIRST_WORD_ID = 2
BROADCAST_WORDS = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def vocabulary(texts: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """All words with their ids, the most frequent first, or the first `size` of them. Words are counted before they
    are shuffled, so a word that is everywhere costs one row per task; ids are places in a range partitioning."""
    counts = texts.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("_less", -F.col("n")))
    return dense_ordinal(counts, ["_less", "word"], below=size, out="token_id").select(
        "word", "n", (F.col("token_id") + FIRST_WORD_ID).alias("token_id"))


def pad_to(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def mask_labels(ids: Column, pad_id: int = PAD) -> Column:
    """Labels are the ids with every pad replaced by -100, real occurrences of the pad id too."""
    return F.transform(ids, lambda x: F.when(x == pad_id, -100).otherwise(x))


def attention_mask(ids: Column, used: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(i < used, 1).otherwise(0))


def tokenize_pad(texts: DataFrame, key: list[str], text: str, vocab: DataFrame, max_length: int = 512) -> DataFrame:
    """input_ids, attention_mask and labels of exactly `max_length`; no other column but the key.

    The key is unique, so regrouping collects at most `max_length` rows. The words with the smallest ids, which are the
    most frequent ones, are broadcast; only words that are not among them are joined by a shuffle.
    """
    ids = vocab.select("word", "token_id")
    common = F.broadcast(ids.where(F.col("token_id") < FIRST_WORD_ID + BROADCAST_WORDS).withColumnRenamed("token_id", "_common"))
    spoken = texts.select(*key, F.posexplode_outer(F.slice(words(F.col(text)), 1, max_length)).alias("pos", "word")).join(
        common, "word", "left")
    rare = ids.where(F.col("token_id") >= FIRST_WORD_ID + BROADCAST_WORDS)
    tokens = (
        spoken.where("_common IS NOT NULL OR word IS NULL").withColumnRenamed("_common", "token_id")
        .unionByName(spoken.where("_common IS NULL AND word IS NOT NULL").drop("_common").join(rare, "word", "left"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(
            "pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("id"))))).alias("_t"))
        .select(*key, F.transform("_t", lambda t: t["id"]).alias("_ids"))
    )
    padded = tokens.select(*key, pad_to(F.col("_ids"), max_length).alias("input_ids"), F.size("_ids").alias("_used"))
    return padded.select(
        *key, "input_ids", attention_mask(F.col("input_ids"), F.col("_used")).alias("attention_mask"),
        mask_labels(F.col("input_ids")).alias("labels"),
    )


def encode_with(texts: DataFrame, key: list[str], text: str, encode: Callable[[list[str]], list[list[int]]],
                max_length: int = 512, pad_id: int = PAD) -> DataFrame:
    """Token columns from a caller's `encode(list of texts) -> list of id lists`, batch by batch."""
    schema = T.StructType([texts.schema[k] for k in key] + [
        T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "attention_mask", "labels")
    ])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ids = [list(x)[:max_length] for x in encode(batch[text].tolist())]
            out = batch[key].copy()
            out["input_ids"] = [x + [pad_id] * (max_length - len(x)) for x in ids]
            out["attention_mask"] = [[1] * len(x) + [0] * (max_length - len(x)) for x in ids]
            out["labels"] = [[-100 if i == pad_id else i for i in x] for x in out["input_ids"]]
            yield out

    return texts.select(*key, text).mapInPandas(run, schema)
