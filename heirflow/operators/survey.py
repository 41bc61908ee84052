"""From survey waves to a training table of current-year inheritances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.functions.draws import uniform
from heirflow.functions.nulls import least_or_null
from heirflow.operators.lookup import lookup_join, row_at_year, settled

WAVES = (2013, 2016, 2019, 2022)
SURVEY_KEY = ("survey_year", "yy1", "y1", "dup_id")

# Fixed values: (wave, year received, probability that it falls in the current year).
# Calibrated in the reference to Gale and Sabelhaus (2024); any other pair has probability 0.
TIMING = (
    (2022, 2022, 1.0),
    (2022, 2020, 0.28),
    (2019, 2019, 0.82),
    (2016, 2015, 0.36),
    (2013, 2013, 1.0),
    (2013, 2010, 0.1),
)

NOT_AN_INHERITANCE = 3


def assemble_survey(
    summary: DataFrame, detail: DataFrame, on: Sequence[str] = ("survey_year", "yy1", "y1")
) -> DataFrame:
    """Summary rows of all waves with their reported transfers."""
    return summary.join(detail, list(on), "left")


def timing_probability(
    wave: Column, year: Column, timing: Sequence[tuple[int, int, float]] = TIMING
) -> Column:
    """Chance that a transfer reported for ``year`` was received in the survey's own year."""
    (w, y, p), *rest = timing
    chance = F.when((wave == w) & (year == y), F.lit(p))
    for w, y, p in rest:
        chance = chance.when((wave == w) & (year == y), F.lit(p))
    return chance.otherwise(F.lit(0.0))


def possible_inheritances(
    events: DataFrame, timing: Sequence[tuple[int, int, float]] = TIMING
) -> DataFrame:
    """Add ``p`` to long events and keep positive ones that are no plain gift and can count."""
    p = timing_probability(F.col("survey_year"), F.col("year"), timing)
    return events.withColumn("p", p).where(
        (F.col("value") > 0) & (F.col("type") != NOT_AN_INHERITANCE) & (F.col("p") > 0)
    )


def realise(
    df: DataFrame,
    seed: int,
    timing: Sequence[tuple[int, int, float]] = TIMING,
    key: Sequence[str] = SURVEY_KEY,
    events: Sequence[int] = (1, 2, 3),
) -> DataFrame:
    """Add ``inheritance``: the largest transfer that the draws place in the current year.

    Null where no event can count, 0 where every possible one is drawn away. The
    three events sit in one row, so nothing is reshaped and nothing is shuffled.
    """
    # The chances are columns of their own, so that each is computed once per row.
    names = {n: f"_p{n}" for n in events}
    df = df.withColumns(
        {
            name: timing_probability(F.col("survey_year"), F.col(f"year_{n}"), timing)
            for n, name in names.items()
        }
    )
    drawn = []
    for n, name in names.items():
        value, kind, p = F.col(f"value_{n}"), F.col(f"type_{n}"), F.col(name)
        u = uniform(*[F.col(k) for k in key], seed=seed, draw=f"event{n}")
        possible = (value > 0) & (kind != NOT_AN_INHERITANCE) & (p > 0)
        drawn.append(F.when(possible, F.when(u < p, value).otherwise(F.lit(0.0))))
    return df.withColumn("inheritance", F.greatest(*drawn)).drop(*names.values())


def with_inheritance(
    df: DataFrame, seed: int, timing: Sequence[tuple[int, int, float]] = TIMING
) -> DataFrame:
    """Survey rows with ``inheritance`` (0 if none) and the flag ``has_inheritance``."""
    amount = F.coalesce("inheritance", F.lit(0.0))
    return realise(df, seed, timing).withColumn("inheritance", amount).withColumn(
        "has_inheritance", (F.col("inheritance") > 0).cast("int")
    )


def demographic_factor(demographic: DataFrame, anchor: int) -> DataFrame:
    """Population of each (married, age) cell in the anchor year over that in each year."""
    demographic = settled(demographic)
    at_anchor = demographic.where(F.col("year") == anchor).select(
        "married", "age", F.col("population").alias("at_anchor")
    )
    joined = lookup_join(demographic, at_anchor, ["married", "age"])
    return joined.select(
        F.col("year").alias("survey_year"),
        "age",
        "married",
        F.try_divide("at_anchor", "population").alias("demographic_factor"),
    )


def asset_factor(net_worth: DataFrame, anchor: int) -> DataFrame:
    """Net worth per head in the anchor year over that in each year."""
    net_worth = settled(net_worth)
    at_anchor = row_at_year(net_worth, anchor)["net_worth_pc"]
    return net_worth.select(
        F.col("year").alias("survey_year"),
        F.try_divide(F.lit(at_anchor), F.col("net_worth_pc")).alias("asset_factor"),
    )


def age_weights(df: DataFrame, demographic: DataFrame, anchor: int) -> DataFrame:
    """Grow weights with the population of the record's age and marital status."""
    factor = demographic_factor(demographic, anchor)
    df = lookup_join(df, factor, ["survey_year", "age", "married"])
    return df.withColumn("weight", F.col("weight") * F.col("demographic_factor")).drop(
        "demographic_factor"
    )


def age_values(
    df: DataFrame, net_worth: DataFrame, anchor: int, value: str = "inheritance"
) -> DataFrame:
    """Grow amounts with net worth per head."""
    df = lookup_join(df, asset_factor(net_worth, anchor), ["survey_year"])
    return df.withColumn(value, F.col(value) * F.col("asset_factor")).drop("asset_factor")


def cap_age(df: DataFrame, cap: int | None, age: str = "age") -> DataFrame:
    """Ages above ``cap`` become ``cap``; None leaves them."""
    return df if cap is None else df.withColumn(age, least_or_null(F.col(age), F.lit(cap)))
