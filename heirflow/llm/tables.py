"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirflow.sources.shared import fresh_path, remove


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Python workers take at most ``rows`` texts at once, so that long ones don't fill an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder once and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later step reads."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that no name of theirs can clash."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, new: list[str]) -> list[Column]:
    """The columns of ``df`` out of ``row``, without those that ``new`` columns replace."""
    taken = {c.lower() for c in new}
    return [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in taken]
