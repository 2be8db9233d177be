"""The corpus pipeline: stages over `documents`, each written and reread."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Scratch, dropping
from corpusloom.llm.mixing import mix
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality_classifier import quality_filter
from corpusloom.llm.simhash import near_dedup
from corpusloom.llm.substring_dedup import substring_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has; those left without a word go."""
    return substring_filter(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the domains want."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixing),
    ("packing", packing),
]

#: The trained and tokenised stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the whole `documents` table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        with dropping():  # a stage's own tables go once its result is written
            docs, path = scratch.put(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
    return docs
