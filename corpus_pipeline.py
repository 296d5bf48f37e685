"""From raw documents to token ids: every stage works on all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockwright.llm import bpe, language, mixing, secrets, simhash
from stockwright.llm.queries import VOCABULARY


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language found; those in none (NULL texts, texts without a letter) go.

    Prototypes are learned from the languages that the documents state.  With no stated language nothing is learned,
    so no document is in any and all go.
    """
    return language.labelled(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, wrapped ones included, is replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all to three times), in training order."""
    return mixing.arranged(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ``ids`` and the text that decodes from them, for every row."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("language id", languages),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", secret_spans),
    ("mixing", mixture),
    ("bpe encoding", tokens),
]

#: Hashes, hyperdimensional vectors and BPE are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
