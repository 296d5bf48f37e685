"""The registered queries of the text operators over the benchmark tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, chat, importance, language, lm, mixing, neighbours, quality, secrets, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the public vocabulary lies.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, table: str, sql: str | None = None, *others: str):
    """Register ``fn(table, *others) -> DataFrame`` under ``name``."""

    def keep(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in (table, *others)])
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_simhash", "documents")
def op1(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs)


@query("op2_secrets", "documents")
def op2(docs: DataFrame) -> DataFrame:
    return secrets.report(docs)


@query("op6_language", "documents")
def op6(docs: DataFrame) -> DataFrame:
    return language.identify(docs)


@query("op7_bpe", "documents")
def op7(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, VOCABULARY)


@query("op10_chat", "conversations")
def op10(chats: DataFrame) -> DataFrame:
    return chat.report(chat.with_control_case(chats.sparkSession, chats), VOCABULARY)


@query("op8_quality", "documents", quality.SQL)
def op8(docs: DataFrame) -> DataFrame:
    return quality.judged(docs)


@query("op3_mixing", "documents", mixing.SQL)
def op3(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).withColumn("position", F.round("position", 6))


@query("op5_neighbours", "embeddings")
def op5(vectors: DataFrame) -> DataFrame:
    return neighbours.nearest(vectors)


@query("op9_lm", "documents")
def op9(docs: DataFrame) -> DataFrame:
    return lm.score_texts(docs)


@query("op4_suffixes", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return suffixes.repeated_passages(docs)


@query("op12_importance", "documents", importance.SQL, "benchmark")
def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance.resample(docs, benchmark)


@query("op13_alignment", "documents")
def op13(docs: DataFrame) -> DataFrame:
    return alignment.report(docs, VOCABULARY, PIECE_MODEL)


@query("op11_toxicity", "documents", None, "labels")
def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.score_texts(docs, labels)
