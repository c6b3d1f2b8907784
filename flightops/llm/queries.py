"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.llm import (
    conversations, decontaminate, merkle, mixing, pii, quality, secrets, simhash, substring_dedup, suffix_dedup, token_counts, token_files,
    toxicity,
)
from flightops.llm.common import documents, fresh_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, folder), keep_text=False).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, folder))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_scan(documents(spark, folder))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(secrets.listed(F.col("base")), 256)
        .alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        "n_live", "n_example")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        documents(spark, folder), _tokenizer("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.quality_rules(documents(spark, folder), labels).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.toxicity(docs, model).select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, folder), items).select(
        "doc_id", "item_id", "n_matched", "n_windows", "coverage", "reparameterised")


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "token-files")
    token_files.write_token_files(
        documents(spark, folder), path, _tokenizer("byte_bpe_50k.json"))
    return token_files.token_digests(spark, path)


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    # every seventh document, by checksum, is found with one more character than it had
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(documents(spark, folder), {"n_chars": found}).drop("path")


def op12_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return conversations.repair_digests(rows, conversations.damaged(rows))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(documents(spark, folder))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[count(pii.KINDS.index(k)).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_mix_sources, op3_secret_scan, op4_token_counts,
             op5_quality_rules, op6_toxicity, op7_simhash, op8_decontaminate, op9_token_files, op10_suffix_dedup,
             op11_merkle_manifest, op12_repair_conversations, op13_personal_data)
    return {f.__name__: f for f in found}
