"""Documents to packed training sequences, in stages that are each written and read again.

Every stage but the last returns documents with all their columns, extra ones too. Rows without an id are documents like
the others. A null text is kept as null until packing, where it is an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import bytescan, mil, repeats, simhash, templates
from plyframe.llm.queries import packed, quality_model, table
from plyframe.plans.scratch import written

KEY = "_plyframe_key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from the labels of `sf_dir` that are not held out."""
    return mil.accepted(docs, quality_model(docs, spark, sf_dir), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without one before them whose five-word shingles are the same to 0.8 or more; exact on candidates of
    linked SimHash fingerprints, and of bands of minima, as fingerprints reach few of those below 0.95."""
    return simhash.representatives(docs, "doc_id", "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur more than once; n_chars follows the text. A document
    made of nothing else stays with an empty text."""
    kept = bytescan.rewritten(docs, "doc_id", "text", repeats.repeated_spans(docs, "doc_id", "text"))
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.withColumns(size) if size else kept


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other parameters."""
    rows = docs.withColumn(KEY, F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text")))
    found = templates.leaks(rows, table(spark, sf_dir, "benchmark"), KEY, "text", "item_id", "text")
    return rows.join(found.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 1,024 ids."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", contaminated),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
