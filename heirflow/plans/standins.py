"""Inputs derived from the order tables, in the shape of the real ones.

Sums of prices are rounded to cents and weights and chances are multiples of
powers of two, so that totals do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirflow.functions.draws import lognormal
from heirflow.operators import macro, survey
from heirflow.operators.calibrate import Bracket
from heirflow.operators.reshape import demographic_long, duplicate

WAVES = (1995, 1996, 1998, 1999)
ANCHOR = 2000
YEARS = (1995, 2001)
LAST_KNOWN = 1999
TIMING = (
    (1995, 1995, 1.0),
    (1995, 1996, 0.28),
    (1996, 1996, 0.82),
    (1998, 1997, 0.36),
    (1999, 1999, 1.0),
    (1999, 1996, 0.1),
)
SEED = 123
FIT_SEED = 8
# The year that is written a second time.
RERUN_YEAR = 1999
# What is asked of the distribution of amounts in a leaf.
DISTRIBUTION_PROBS = (0.5, 0.75, 0.9, 0.99)
DISTRIBUTION_BOUND = 20_000.0
HEIRS = 2.8
EXEMPTIONS = {"baseline": 7.2e5, "reform": 1.5e6}
EDGES = (5e5, 1e6, 2e6, 5e6)
ADDED = ("wages", "sole_prop", "kg_lt")
SUBTRACTED = ("rent_loss",)
AGES = range(18, 81)
# Estate counts for 1,500 units; they grow with the number of units.
BRACKETS = (
    Bracket(5e5, 1e6, 50, 0.75e6),
    Bracket(1e6, 2e6, 120, 1.5e6),
    Bracket(2e6, 5e6, 30, 3e6),
    Bracket(5e6, None, 10, 17.5e6),
)
BRACKET_UNITS = 1500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax units: customers with their orders as income components."""
    key = F.col("c_custkey")

    def total(status: str) -> Column:
        price = F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))
        return F.round(F.sum(price), 2)

    incomes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        total("F").alias("wages"), total("O").alias("sole_prop"), total("P").alias("rent_loss")
    )

    def dependant(every: int, span: int) -> Column:
        return F.when(key % every == 0, key % span).cast("int")

    customers = table(spark, sf_dir, "customer").select(
        key.alias("id"),
        (1 + key % 7).cast("double").alias("weight"),
        (18 + key % 75).cast("int").alias("age1"),
        (1 + F.col("c_nationkey") % 4).cast("int").alias("filing_status"),
        dependant(3, 30).alias("dep_age1"),
        dependant(5, 25).alias("dep_age2"),
        dependant(7, 20).alias("dep_age3"),
        F.round(F.lit(100.0) * F.col("c_acctbal"), 2).alias("kg_lt"),
    )
    joined = customers.join(incomes, customers["id"] == incomes["o_custkey"], "left").drop("o_custkey")
    return joined.fillna(0.0, ["wages", "sole_prop", "rent_loss"])


def imputed(df: DataFrame) -> DataFrame:
    """``units`` with a given chance and a drawn amount."""
    chance = (F.lit(20.0) + F.col("age1") % 50) / F.lit(1024.0)
    mu = F.lit(10.0) + F.lit(0.01) * F.col("age1")
    amount = lognormal(mu, F.lit(1.2), F.col("id"), seed=FIT_SEED)
    return df.withColumn("p_inheritance", chance).withColumn("inheritance", F.round(amount, 2))


def imputed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, weight, age1, filing_status, p_inheritance, inheritance."""
    return imputed(units(spark, sf_dir)).select(
        "id", "weight", "age1", "filing_status", "p_inheritance", "inheritance"
    )


def brackets(df: DataFrame) -> list[Bracket]:
    """Test brackets for the number of rows of ``df``."""
    size = df.count() / BRACKET_UNITS
    return [Bracket(b.low, b.high, b.count * size, b.average) for b in BRACKETS]


def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey waves: every order, in the last wave that began by its year (the first one if none did)."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    year, wave = F.year("o_orderdate"), F.lit(WAVES[0])
    for begun in WAVES[1:]:
        wave = F.when(year >= begun, F.lit(begun)).otherwise(wave)
    return table(spark, sf_dir, "orders").select(
        wave.alias("survey_year"),
        F.expr("o_orderkey div 5").alias("yy1"),
        order.alias("y1"),
        (1 + order % 9).cast("double").alias("weight"),
        (18 + customer % 63).cast("int").alias("age"),
        (order % 2).cast("int").alias("married"),
        (customer % 3 == 0).cast("int").alias("has_kids"),
        F.round(F.col("o_totalprice") - 20000.0, 2).alias("income"),
    )


def survey_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported transfers: all lines of each order in three slots, by their number.

    A slot holds the total of its lines and the year of the latest one; lines of one slot have one type.
    """
    number = F.col("l_linenumber")
    measures = {
        "type": lambda own: F.max(F.when(own, 1 + number % 3)).cast("int"),
        "value": lambda own: F.round(F.sum(F.when(own, F.col("l_extendedprice"))), 2),
        "year": lambda own: F.max(F.when(own, F.year("l_shipdate"))),
    }
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("y1")).agg(
        *[
            build((number - 1) % 3 == n - 1).alias(f"{measure}_{n}")
            for n in (1, 2, 3)
            for measure, build in measures.items()
        ]
    )


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled waves."""
    return survey.assemble_survey(
        survey_summary(spark, sf_dir), survey_detail(spark, sf_dir), on=["y1"]
    )


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicated survey rows with their current-year inheritance."""
    df = survey.with_inheritance(duplicate(surveys(spark, sf_dir), 5), SEED, TIMING)
    return df.select(
        *survey.SURVEY_KEY, "weight", "age", "married", "has_kids", "income",
        "inheritance", "has_inheritance",
    )


def economic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GDP is the order volume of a year; prices grow by a fixed step."""
    prices = F.lit(100.0) + F.lit(2.5) * (F.col("year") - F.lit(YEARS[0]))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("gdp"))
        .select("year", "gdp", (prices + F.lit(1.0)).alias("cpiu"), prices.alias("ccpiu_irs"))
    )


def demographic_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 plus the orders of each (year, status, age), one column per cell."""
    status = F.when(F.col("o_orderkey") % 2 == 1, F.lit("married")).otherwise(F.lit("unmarried"))
    cell = F.concat(status, F.lit("_"), (18 + F.col("o_custkey") % 63).cast("string"))
    cells = [f"{s}_{a}" for s in ("married", "unmarried") for a in AGES]
    counts = (
        table(spark, sf_dir, "orders")
        .select(F.year("o_orderdate").alias("year"), cell.alias("cell"))
        .groupBy("year")
        .pivot("cell", cells)
        .count()
    )
    return counts.select(
        "year",
        *[(F.lit(100.0) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in cells],
        F.lit(1.0).alias("married_NA"),
    )


def demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population by year, married and age."""
    return demographic_long(demographic_wide(spark, sf_dir))


def macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economic and demographic columns in one table, as in the macro files."""
    return economic(spark, sf_dir).join(demographic_wide(spark, sf_dir), "year")


def net_worth_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value by quarter as text, one kept quarter without data."""
    when = F.col("l_shipdate")
    date = F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string"))
    value = F.round(F.sum("l_extendedprice") / 1e3, 2).cast("string")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(date.alias("date"))
        .agg(value.alias("value"))
        .select(
            "date",
            F.when(F.col("date") == "1997-Q3", F.lit("ND")).otherwise(F.col("value")).alias("net_worth"),
        )
    )


def net_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net worth per head, 1995 to 2001."""
    return macro.net_worth_per_capita(
        net_worth_quarterly(spark, sf_dir),
        economic(spark, sf_dir),
        demographic(spark, sf_dir),
        YEARS[0],
        LAST_KNOWN,
        YEARS[1],
    )
