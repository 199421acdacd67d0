"""Labelled rows for training: which labels may be seen, and a sample whose size is a stated bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fold

#: Labelled documents that a classifier is fitted on at most; a parameter of each classifier.
SAMPLE = 4000


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row per labelled id, label 0 or 1; where rows of an id differ the larger counts."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``size`` labelled documents outside the held-out fold.

    The ones with the smallest hashes of their ids are taken, so the sample doesn't depend on how rows are dealt; of
    rows that share an id the first text in order counts, so an id never brings more than one row.
    """
    marked = labels_of(labels, column).filter(fold(parts) != held_out)
    chosen = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(size).drop("h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
