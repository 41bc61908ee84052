"""Stand-in inputs written as files of the real layout, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heirflow.operators import macro, survey
from heirflow.operators.reshape import demographic_long
from heirflow.operators.units import unit_income
from heirflow.plans import standins as s
from heirflow.sources import readers
from heirflow.sources.schemas import INCOME_ADDED, INCOME_SUBTRACTED, TRANSFER_COLUMNS
from heirflow.sources.shared import fresh_path, materialise

MACRO_FILES = ("projections.csv", "historical.csv")


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "NA").csv(path)


def write_macro(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Two files; the columns of the second are in reverse order."""
    wide = s.macro_wide(spark, sf_dir)
    _csv(wide.where("year >= 1999"), f"{root}/{MACRO_FILES[0]}")
    _csv(wide.where("year < 1999").select(*reversed(wide.columns)), f"{root}/{MACRO_FILES[1]}")


def write_survey(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A summary file and a detail file for each wave, under the names of the real columns."""
    summary = s.survey_summary(spark, sf_dir)
    detail = summary.select("survey_year", "yy1", "y1").join(s.survey_detail(spark, sf_dir), "y1", "left")
    real = {
        "YY1": "yy1", "Y1": "y1", "WGT": "weight", "AGE": "age", "MARRIED": F.expr("2 - married"),
        "KIDS": F.expr("2 * has_kids"), "INCOME": "income",
    }
    names = {
        f"{measure}_{n}": column
        for n, columns in TRANSFER_COLUMNS.items()
        for measure, column in zip(("type", "value", "year"), columns)
    }
    for wave in s.WAVES:
        folder = f"{root}/{wave}/historical"
        rows = summary.where(F.col("survey_year") == wave)
        _csv(
            rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in real.items()]),
            f"{folder}/SCFP{wave}.csv",
        )
        detail.where(F.col("survey_year") == wave).drop("survey_year").withColumnsRenamed(names).write.parquet(
            f"{folder}/p{wave % 100:02d}i6.parquet"
        )


def macro_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "macro")
    write_macro(spark, sf_dir, root)
    wide = readers.read_macro(spark, root, MACRO_FILES)
    return macro.economic(wide).join(macro.population_by_year(demographic_long(wide)), "year")


def survey_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "survey")
    write_survey(spark, sf_dir, root)
    return survey.assemble_survey(*readers.read_survey(spark, root, s.WAVES))


def survey_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waves laid out as tables partitioned by wave, read in one scan each."""
    files, table = fresh_path(spark, "survey"), fresh_path(spark, "waves")
    write_survey(spark, sf_dir, files)
    readers.write_wave_table(*readers.read_survey(spark, files, s.WAVES), table)
    return survey.assemble_survey(*readers.read_wave_table(spark, table, s.TIMING))


def cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a tax-unit file that are no numbers, counted by column while the file is read."""
    path = f"{fresh_path(spark, 'units')}/tax_units.csv"
    units = s.units(spark, sf_dir)
    spoilt = {
        "age1": F.when(F.col("id") % 17 == 0, "forty").otherwise(F.col("age1").cast("string")),
        "wages": F.when(F.col("id") % 11 == 0, "n/a").otherwise(F.col("wages").cast("string")),
        "dep_age1": F.when(F.col("id") % 13 == 0, "-").otherwise(F.col("dep_age1").cast("string")),
    }
    other = [c for c in (*INCOME_ADDED, *INCOME_SUBTRACTED) if c not in units.columns]
    _csv(units.withColumns({c: F.lit(0.0) for c in other} | spoilt), path)
    failures = Observation()
    materialise(readers.read_tax_units(spark, path, failures=failures))
    return readers.failed_casts(spark, failures)


def net_worth_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'accounts')}/b101.csv"
    _csv(s.net_worth_quarterly(spark, sf_dir).withColumnRenamed("net_worth", "FL152090005.Q"), path)
    return readers.read_net_worth(spark, path)


def tax_unit_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'units')}/tax_units.csv"
    units = s.units(spark, sf_dir)
    other = [c for c in (*INCOME_ADDED, *INCOME_SUBTRACTED) if c not in units.columns]
    _csv(units.withColumns({c: F.lit(0.0) for c in other}), path)
    return unit_income(readers.read_tax_units(spark, path)).select(
        "id", "weight", "age1", "filing_status", "dep_age1", "dep_age2", "dep_age3", "income"
    )
