"""The shared folder for checkpoints and tables that are written to be read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a temporary one only for an unset local session."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="heirflow-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scratch: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier call returned."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored under a fresh path inside is deleted on leaving."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Rows stored as Parquet in the shared folder: later passes read the columns they need, also after losing executors."""
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
