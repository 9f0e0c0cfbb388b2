"""Contiguous train/validation/test prefixes of the valid samples, in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.operators.samples import valid_samples
from plyframe.plans.ordinals import dense_ordinal
from plyframe.plans.scratch import written


def take_first_valid(docs: DataFrame, n: int, key: str) -> DataFrame:
    """The first `n` valid samples by `key`, numbered from 0 in `ord`, without labelling the whole corpus.

    The largest of the first `4 n` keys is a literal bound on the documents that are labelled: the filter reaches the
    scan, which skips row groups beyond it, and nothing of the corpus is shuffled. While too few of them are valid and
    keys are left, the bound moves on fourfold. Labels are written once, for counting and numbering.
    """
    reach = 4 * max(n, 1)
    while True:
        keys = docs.select(key).where(F.col(key).isNotNull()).orderBy(key).limit(reach)
        bound, seen = keys.agg(F.max(key), F.count("*")).first()
        prefix = docs.where(F.col(key) <= F.lit(bound))
        samples = written(valid_samples(prefix, key))
        if seen < reach or samples.count() >= n:
            return dense_ordinal(samples, key, below=n)
        reach *= 4


def _split_of(ord_: Column, train: int, val: int) -> Column:
    return F.when(ord_ < train, "train").when(ord_ < train + val, "val").otherwise("test")


def sequential_split(samples: DataFrame, train: int, val: int, test: int, key: str, skip: int = 0) -> DataFrame:
    """Add `ord`, unless the samples have it, and `split`. Short input gives short or empty tails. `skip` starts later,
    which keeps an evaluation set apart from the rows trained on."""
    rows = samples if "ord" in samples.columns else dense_ordinal(samples, key)
    rows = rows.where(F.col("ord").between(skip, skip + train + val + test - 1))
    return rows.withColumn("split", _split_of(F.col("ord") - skip, train, val))


def split_counts(split: DataFrame) -> DataFrame:
    """Rows per split; an empty split is reported as 0."""
    names = split.sparkSession.range(3).select(
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") + 1).cast("int")).alias("split")
    )
    counts = split.groupBy("split").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counts), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def eval_samples(samples: DataFrame, n: int, key: str, skip: int = 0) -> DataFrame:
    """The evaluation set: the first `n` valid samples, numbered. Numbers are never reassigned when
    a row fails later, so failures leave gaps."""
    return sequential_split(samples, 0, 0, n, key, skip).select(
        F.col("ord").alias("id"), *[c for c in samples.columns if c not in ("id", "ord")]
    )
