"""From raw documents to token files, in five stages.

Each stage is ``(name, function)``; the function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the ``docs`` of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flightops.llm import decontaminate, mixing, quality, simhash, token_files
from flightops.llm.common import documents, fresh_folder, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels).where("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that is taken twice has two rows."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what reading them back gives for each document."""
    import public_tokenizers

    path = fresh_folder(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_digests(spark, path)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token files", token_stage),
]
ORACLE_SQL = None  # the hashes of two stages and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
