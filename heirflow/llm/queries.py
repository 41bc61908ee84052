"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heirflow.llm import (
    byte_bpe, chats, decontaminate, language, ngram_join, periodic, pii, quality, repair, sharding, suffixes, token_store, vectors,
)
from heirflow.llm.tables import read_table
from heirflow.sources.shared import fresh_path

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_report(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, sf_dir, "documents"), 8)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_report(read_table(spark, sf_dir, "documents"), 3, 90)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_store.token_report(docs, fresh_path(spark, "tokens"), public_tokenizers.path(BYTE_BPE))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chat_report(read_table(spark, sf_dir, "conversations"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_report(read_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(read_table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_suffix_dedup, op3_sharding, op4_ngram_jaccard, op5_token_store, op6_quotation_linking,
        op7_byte_bpe, op8_decontaminate, op9_vector_dedup, op10_pii, op11_periodic_runs, op12_quality,
        op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_quotation_linking": chats.CHAT_SQL}
