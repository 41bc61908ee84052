"""Macro series: population totals, net worth per head, growth and price indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.operators.lookup import lookup_join, refuse_repeats, row_at_year, settled


def economic(macro: DataFrame) -> DataFrame:
    """year, gdp, cpiu, ccpiu_irs."""
    return macro.select("year", "gdp", "cpiu", "ccpiu_irs")


def population_by_year(demographic: DataFrame) -> DataFrame:
    """Total population, missing cells counted as nothing."""
    return demographic.groupBy("year").agg(
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("population")
    )


def net_worth_per_capita(
    quarterly: DataFrame,
    economic: DataFrame,
    demographic: DataFrame,
    first: int = 2013,
    last_known: int = 2023,
    last: int = 2026,
    quarter: str = "Q3",
) -> DataFrame:
    """Net worth per head of one quarter a year, carried past ``last_known`` with GDP.

    ``quarterly`` is (date 'YYYY?Qn', net_worth in millions as text).
    """
    known = (
        quarterly.withColumn("year", F.substring("date", 1, 4).try_cast("int"))
        .where((F.substring("date", 6, 2) == quarter) & F.col("year").between(first, last_known))
        .select("year", F.col("net_worth").try_cast("double").alias("net_worth"))
    )
    later = known.sparkSession.range(last_known + 1, last + 1).select(
        F.col("id").cast("int").alias("year")
    )
    series = known.unionByName(later, allowMissingColumns=True)
    series = settled(lookup_join(series, economic.select("year", "gdp"), ["year"]))
    base = row_at_year(series, last_known)
    carried = F.lit(base["net_worth"]).cast("double") * F.try_divide(
        F.col("gdp"), F.lit(base["gdp"]).cast("double")
    )
    series = series.withColumn(
        "net_worth", F.when(F.col("year") > last_known, carried).otherwise(F.col("net_worth"))
    )
    series = lookup_join(series, population_by_year(demographic), ["year"])
    per_head = F.try_divide(F.col("net_worth") * F.lit(1e6), F.col("population"))
    return series.select("year", per_head.alias("net_worth_pc"))


def projection_indexes(
    economic: DataFrame, demographic: DataFrame, first: int, last: int, anchor: int
) -> DataFrame:
    """year, inflation_index (chained prices) and gdp_pc_index, both 1 in the anchor year."""
    refuse_repeats(economic, ["year"], "economic series")
    refuse_repeats(demographic, ["year", "married", "age"], "population")
    years = economic.where(F.col("year").between(first, last))
    years = lookup_join(years, population_by_year(demographic), ["year"]).withColumn(
        "gdp_pc", F.try_divide("gdp", "population")
    )
    years = settled(years)
    base = row_at_year(years, anchor)
    return years.select(
        "year",
        F.try_divide(F.col("ccpiu_irs"), F.lit(base["ccpiu_irs"])).alias("inflation_index"),
        F.try_divide(F.col("gdp_pc"), F.lit(base["gdp_pc"])).alias("gdp_pc_index"),
    )
