"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, encoding.

Each stage reads what its predecessor wrote as Parquet in the shared folder. All but the last return the columns of
their input; the last returns each taken document's tokens as digests, a repeated document once per repetition.
Each stage begins with small heaps, whatever its predecessors needed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, exact_dedup, mixing, ngram_join, quality_cotrain
from terrane.session import cut, shrink_heaps


def rested(stage: Callable) -> Callable:
    """A stage that lets executors give back the memory of earlier stages first."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@rested
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


@rested
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


@rested
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


@rested
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, as in the query of the encoder, with less memory beside what earlier stages hold."""
    return bpe.digests(docs, bpe.default_vocabulary(), kept_words=120_000)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to target weights", mix), ("BPE encoding", encode)]

#: Classifier and near duplicates are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
