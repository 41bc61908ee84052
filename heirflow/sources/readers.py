"""Readers for macro series, net worth, survey waves and tax units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirflow.sources.schemas import (
    NET_WORTH,
    SURVEY_DETAIL,
    SURVEY_SUMMARY,
    TAX_UNITS,
    TRANSFER_COLUMNS,
)


def typed(df: DataFrame, schema: T.StructType, failures: Observation | None = None) -> DataFrame:
    """Keep the columns of ``schema`` by name and cast them; text that is no number becomes null.

    ``failures`` counts, by column, the texts that became null. It is filled by the first action on the
    result, in the same pass; :func:`failed_casts` gives the counts as a table.
    """
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    if failures is not None:
        lost = [F.count_if(F.col(f"`{n}`").isNotNull() & c.isNull()).alias(n) for n, c in cast.items()]
        df = df.observe(failures, *lost)
    return df.select(*[c.alias(n) for n, c in cast.items()])


def failed_casts(spark: SparkSession, failures: Observation) -> DataFrame:
    """``column, failed`` of an observation that an action has filled."""
    return spark.createDataFrame(list(failures.get.items()), "column string, failed long")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, failures: Observation | None = None) -> DataFrame:
    """CSV with a header, matched to ``schema`` by column name, whatever the file's column order."""
    return typed(spark.read.option("header", True).option("nullValue", "NA").csv(path), schema, failures)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by name; a column one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_macro(spark: SparkSession, root: str, files: Sequence[str]) -> DataFrame:
    """Macro files joined by column name: integer ``year``, everything else double."""
    frames = []
    for name in files:
        raw = spark.read.option("header", True).option("nullValue", "NA").csv(f"{root}/{name}")
        kinds = [
            T.StructField(c, T.IntegerType() if c == "year" else T.DoubleType()) for c in raw.columns
        ]
        frames.append(typed(raw, T.StructType(kinds)))
    return union_by_name(frames)


def read_net_worth(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly household net worth: (date, net_worth), both still text."""
    return read_csv(spark, path, NET_WORTH).select(
        "date", F.col("`FL152090005.Q`").alias("net_worth")
    )


def survey_summary(raw: DataFrame, wave: int) -> DataFrame:
    """One wave of the summary file under the names used here."""
    return raw.select(
        F.lit(wave).alias("survey_year"),
        F.col("YY1").alias("yy1"),
        F.col("Y1").alias("y1"),
        F.col("WGT").alias("weight"),
        F.col("AGE").alias("age"),
        (F.col("MARRIED") == 1).cast("int").alias("married"),
        (F.col("KIDS") > 0).cast("int").alias("has_kids"),
        F.col("INCOME").alias("income"),
    )


def survey_detail(raw: DataFrame, wave: int) -> DataFrame:
    """One wave of the detail file: type_n, value_n, year_n for n = 1, 2, 3."""
    renamed = [
        F.col(source).alias(f"{measure}_{n}")
        for n, sources in TRANSFER_COLUMNS.items()
        for measure, source in zip(("type", "value", "year"), sources)
    ]
    return raw.select(F.lit(wave).alias("survey_year"), "yy1", "y1", *renamed)


def read_survey(
    spark: SparkSession, root: str, waves: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """All waves of the summary (CSV) and detail (Parquet) files, the wave in ``survey_year``."""
    summaries, details = [], []
    for wave in waves:
        folder = f"{root}/{wave}/historical"
        summary = read_csv(spark, f"{folder}/SCFP{wave}.csv", SURVEY_SUMMARY)
        detail = typed(spark.read.parquet(f"{folder}/p{wave % 100:02d}i6.parquet"), SURVEY_DETAIL)
        summaries.append(survey_summary(summary, wave))
        details.append(survey_detail(detail, wave))
    return union_by_name(summaries), union_by_name(details)


def write_wave_table(summary: DataFrame, detail: DataFrame, root: str) -> None:
    """Lay the waves of :func:`read_survey` out as two tables partitioned by wave; one write each."""
    for name, rows in (("summary", summary), ("detail", detail)):
        rows.write.partitionBy("survey_year").mode("errorifexists").parquet(f"{root}/{name}")


def read_wave_table(
    spark: SparkSession, root: str, timing: Sequence[tuple[int, int, float]]
) -> tuple[DataFrame, DataFrame]:
    """Summary and detail of the waves that ``timing`` (wave, year, chance) names: one scan each, whatever the number of waves.

    Other waves' files are pruned by partition; columns follow the stored schema, the wave in ``survey_year``.
    """
    waves = sorted({wave for wave, _, _ in timing})
    found = []
    for name in ("summary", "detail"):
        rows = spark.read.parquet(f"{root}/{name}")
        rest = [c for c in rows.columns if c != "survey_year"]
        found.append(rows.where(F.col("survey_year").isin(waves)).select("survey_year", *rest))
    return found[0], found[1]


def read_tax_units(
    spark: SparkSession, path: str, kind: str = "csv", failures: Observation | None = None
) -> DataFrame:
    """Tax units from CSV, or from a Parquet copy of it, which prunes columns at the scan."""
    if kind == "csv":
        return read_csv(spark, path, TAX_UNITS, failures)
    return typed(spark.read.parquet(path), TAX_UNITS, failures)
