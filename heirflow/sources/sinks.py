"""Writers for scenario results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirflow.sources.readers import typed
from heirflow.sources.schemas import ESTATE_TAX_DETAIL

_LAYOUT = ("scenario", "year")


def run_folder(root: str, run_id: str) -> str:
    """Folder of one run, so that runs never overwrite each other."""
    return f"{root.rstrip('/')}/{run_id}"


def write_scenarios(
    df: DataFrame, folder: str, kind: str = "parquet", files: int | None = None
) -> None:
    """Write every scenario and year in one job, one subfolder per (scenario, year).

    Each task writes its own part files without a shuffle; with ``files``, rows are dealt out by
    cell and id first, and a cell has at most that many files whatever the number of tasks.
    """
    columns = [f.name for f in ESTATE_TAX_DETAIL.fields]
    df = df.select(*_LAYOUT, *columns)
    if files is not None:
        df = df.repartition(*_LAYOUT, F.pmod(F.xxhash64("id"), F.lit(files)))
    writer = df.write.partitionBy(*_LAYOUT).mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(kind).save(folder)


def rewrite_cells(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Write the (scenario, year) cells of ``df`` again; cells that it doesn't hold keep their files.

    A cell is replaced as a whole when the job commits, so a run of one year can be repeated. Rows are rebalanced by cell,
    which gives files of about the session's advisory size: small cells one, large ones several.
    """
    df = df.select(*_LAYOUT, *[f.name for f in ESTATE_TAX_DETAIL.fields]).hint("rebalance", *_LAYOUT)
    writer = df.write.partitionBy(*_LAYOUT).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if kind == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(kind).save(folder)


def read_scenarios(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """Read a folder written by ``write_scenarios``; filters on scenario and year prune files."""
    layout = [T.StructField("scenario", T.StringType()), T.StructField("year", T.IntegerType())]
    if kind == "csv":
        stored = [T.StructField(f.name, T.StringType()) for f in ESTATE_TAX_DETAIL.fields]
    else:
        stored = list(ESTATE_TAX_DETAIL.fields)
    reader = spark.read.schema(T.StructType(stored + layout))
    reader = reader.options(header=True, nullValue="NA") if kind == "csv" else reader
    return typed(
        reader.format(kind).load(folder), T.StructType(layout + list(ESTATE_TAX_DETAIL.fields))
    )
