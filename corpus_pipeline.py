"""A corpus from raw documents to token-ready texts, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirflow.llm import byte_bpe, decontaminate, language, ngram_join, pii
from heirflow.llm.queries import BYTE_BPE_RANKS
from heirflow.llm.tables import read_table, small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go. Trained on the stage's own labelled rows."""
    small_batches(spark)
    return language.keep_identified(docs, language.train(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar by 0.8 or more."""
    small_batches(spark)
    return ngram_join.keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised to its kind; ``n_chars`` follows the text."""
    small_batches(spark)
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the ids of each remaining text and of the bytes they decode to."""
    small_batches(spark)
    return byte_bpe.bpe_report(docs, public_tokenizers.path(BYTE_BPE_RANKS))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe_ids),
]

#: Trained models and shingle signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
