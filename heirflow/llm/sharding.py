"""Sharding by jump consistent hashing of a stable key.

The key of a document is its ``doc_id`` alone, so the law is ``key``: a document goes to the same
shard whatever else the corpus holds, and with one more shard it stays or moves into the new one.
There is no ring table; the shard is a walk over pseudo-random jumps of a 64-bit generator.

Defined cases: columns called like a new one are replaced, others carried; a null ``doc_id`` has key -1; a null text has size 1 and CRC 0 (that of no bytes);
repeated rows go to one shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heirflow.llm.tables import packed, unpacked

#: Rows that one numbering bucket of one shard holds on average.
ROWS_PER_BUCKET = 200_000
#: Most (shard, bucket) counts, which are broadcast; with more rows the buckets grow instead.
MAX_COUNTS = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; about ln(shards) jumps each."""
    if shards < 1:
        raise ValueError("need at least one shard")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.float64)
    live = np.arange(len(state))
    while len(live):
        at[live] = target[live].astype(np.int64)
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        target[live] = np.floor((at[live] + 1) * (float(1 << 31) / draw))
        live = live[target[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of :func:`jump` for a long key."""

    @pandas_udf("int")
    def assign(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return assign(F.coalesce(key, F.lit(-1)).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with ``shard``, ``grown_shard`` (one shard more) and ``slot``, gapless from 0 in each shard.

    Slots are numbered per (shard, bucket of the key) and moved up by the counts of the buckets
    before, so that no task holds a whole shard. The counts, at most ``MAX_COUNTS``, come from the
    narrow key column and are broadcast.
    """
    rows = docs.count()
    buckets = max(1, min(MAX_COUNTS // shards, math.ceil(rows / shards / ROWS_PER_BUCKET) * 4))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "doc_id"), F.lit(buckets)).cast("int")
    place = (jump_shard(F.col("doc_id"), shards).alias("shard"), bucket.alias("bucket"))
    counts = docs.select(*place).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    ordered = Window.partitionBy("shard", "bucket").orderBy("doc_id")
    numbered = docs.select(
        packed(docs), "doc_id", *place, jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard")
    ).withColumn("rank", F.row_number().over(ordered))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        *unpacked(docs, ["shard", "grown_shard", "slot"]),
        "shard", "grown_shard", (F.col("offset") + F.col("rank") - 1).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write ``docs`` as Parquet folders ``shard=<k>``; each task writes its part of each shard."""
    docs.withColumn("shard", jump_shard(F.col("doc_id"), shards)).write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of the placement: size and CRC of the text, law, shard, slot, grown shard."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard_documents(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
    )
