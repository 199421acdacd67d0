"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import packing, quality, repeats, rules, simhash
from skein.llm.common import new_folder, table


#: Bytes of a repeat that the pipeline removes: under fifty words of three letters each with their spaces, so every
#: passage of over fifty words that repeats is longer but for ones of very short words.
PASSAGE = 200


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages of PASSAGE bytes and more that repeat."""
    return repeats.rewrite(docs, PASSAGE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.placed(packing.pack(docs))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express a trained classifier, connected components or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again by the next."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
