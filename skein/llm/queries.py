"""The thin queries over the standard tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, idstore, infill, licenses, media, merkle, oracles, packing, quality, repeats, rules, simhash, suffix_tree, toxicity
from skein.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = media.store(table(spark, sf_dir, "documents"))
    return media.read_back(index, folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("stored_sha256").alias("media_sha256"), "feature", "width", "height",
    )


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return repeats.remove(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(packing.pack(table(spark, sf_dir, "documents")))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op11_infill_ropes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.restore(infill.transform(table(spark, sf_dir, "documents"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idstore.write(table(spark, sf_dir, "documents"))
    return idstore.digests(idstore.read(spark, folder))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_media_columns, op2_repeated_passages, op3_quality_classifier, op4_simhash_components, op5_suffix_tree_scores, op6_license_scan, op7_toxicity, op8_lexical_packing, op9_bpe_round_trip, op10_quality_rules,
            op11_infill_ropes, op12_merkle_manifest, op13_token_files,
        )
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
