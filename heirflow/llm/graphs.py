"""Connected components by rounds of joins, and a bounded filter that saves shuffling whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heirflow.llm.tables import forget, stored

#: Largest bit map that is broadcast, in bits (16 MB); beyond it only the share of false hits grows.
MAX_FILTER_BITS = 1 << 27


#: Keys that hold more than one row in so many are hot, and so there are at most so many of them.
HOT_KEYS = 1_000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of a stored ``left`` to ``right``, whose ``key`` is unique, without one task for a hot key.

    Rows of ``right`` for the hot keys of ``left``, at most ``HOT_KEYS``, are broadcast; rows that find theirs there
    are dealt at random in the join for all other keys.
    """
    values = [c for c in right.columns if c != key]
    rows = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT_KEYS > max(rows, HOT_KEYS)).select(key)
    sent = right.join(F.broadcast(hot), key).select(key, F.struct(*values).alias("_sent"))
    dealt = left.join(F.broadcast(sent), key, "left").withColumn(
        "_salt", F.when(F.col("_sent").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(9973)))
    )
    # always 0, but no constant: that would leave the salt out of the keys the rows are dealt by
    none = F.pmod(F.xxhash64(key), F.lit(1).cast("long")).alias("_salt")
    other = right.select(key, F.struct(*values).alias("_met"), none)
    met = F.coalesce("_sent", "_met")
    return dealt.join(other, [key, "_salt"], "left").select(*left.columns, *[met[c].alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (columns ``a, b``): the smallest node that can be reached.

    Every round gives each node the smallest label among its neighbours, then the label of its label,
    so that long chains shrink by powers. Each round is stored, which cuts the lineage.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "cc-edges"
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "cc-labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        )
        lower = stored(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")), "cc-lower")
        # the label of a large component is the key of many rows
        jumped = spread_join(lower, lower.select(F.col("node").alias("new"), F.col("new").alias("far")), "new")
        far = F.least("new", F.coalesce("far", "new"))
        moved = stored(jumped.select("node", far.alias("label"), (F.col("label") != far).alias("moved")), "cc-labels")
        forget(lower)
        forget(labels)
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            forget(both)
            return labels


def key_filter(keys: DataFrame, bits: int | None = None) -> tuple[np.ndarray, int]:
    """Bit map of the 64-bit keys in the only column of ``keys``: about 12 bits a key up to the bound."""
    name = keys.columns[0]
    size = 1 << 12
    count = keys.count()
    while size < min(12 * count, MAX_FILTER_BITS):
        size *= 2
    size = bits or size
    mask = size - 1
    places = [F.col(name).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(mask))]
    words = (
        keys.select(F.explode(F.array(*places)).alias("p"))
        .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63L AS int))").alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    )
    out = np.zeros(size >> 6, np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    return out, mask


def _inside(table: np.ndarray, mask: int, keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.int64).view(np.uint64)
    inside = np.ones(len(keys), bool)
    for p in (keys & np.uint64(mask), (keys >> np.uint64(32)) & np.uint64(mask)):
        inside &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return inside


def probably_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose 64-bit ``key`` may be in ``keys``; no row that is in them is lost.

    A semi-join reducer of bounded size in front of an exact join.
    """
    table, mask = key_filter(keys)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(shared.value, mask, batch[key].to_numpy(zero_copy_only=False))))

    return df.mapInArrow(keep, df.schema)


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: whether ``key`` may be in ``keys``; only the key itself goes to Python."""
    table, mask = key_filter(keys)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def look(values: pd.Series) -> pd.Series:
        return pd.Series(_inside(shared.value, mask, values.to_numpy()))

    return df.withColumn("maybe", look(F.col(key)))
