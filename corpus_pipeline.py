"""The corpus pipeline: stages that each apply one operator of `sievework.llm` to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from sievework.llm import bpe, curriculum, simhash, toxicity
from sievework.session import work_path

# SQL cannot express the classifier, the fingerprints or the token ids: tests/llm holds brute-force versions.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of the table, does not call toxic."""
    labelled, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accept(docs, "text", toxicity.train(labelled, labels, "doc_id", "text", "toxic"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints hang together."""
    return simhash.keep_one(docs, "doc_id", "text")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return curriculum.in_order(docs, "doc_id", "text", "source")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return bpe.encode_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("near-dedup", dedup_stage), ("mix", mix_stage), ("bpe", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
