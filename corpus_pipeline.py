"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, tokens.

Each stage gets the documents that the one before kept and returns documents with the same columns; the
last returns a digest of each document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.bagminhash import drop_near_copies
from corvane.llm.bpe_automaton import bpe_encode, digests, word_bpe_path
from corvane.llm.exact_dedup import drop_exact_copies
from corvane.llm.frames import remove_table, table_path
from corvane.llm.quality_rules import keep_good
from corvane.llm.source_mixing import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return drop_exact_copies(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; a document read in two epochs stands twice."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: their number, and digests of the ids and of the decoded text."""
    return digests(bpe_encode(docs, word_bpe_path()))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Multiset shingle classes and the mix's water levels have no SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = table_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
