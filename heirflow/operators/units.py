"""Features of tax-unit records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.operators.ordered import rank_bins
from heirflow.operators.survey import cap_age
from heirflow.sources.schemas import INCOME_ADDED, INCOME_SUBTRACTED
from heirflow.sources.shared import materialise


MARRIED_FILING = 2
CHILD_AGE = 17


def unit_income(
    df: DataFrame,
    added: Sequence[str] = INCOME_ADDED,
    subtracted: Sequence[str] = INCOME_SUBTRACTED,
    out: str = "income",
) -> DataFrame:
    """Sum of income components less losses; null as soon as one component is."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in added])
    return df.withColumn(out, reduce(lambda a, b: a - b, [F.col(c) for c in subtracted], total))


def unit_features(
    df: DataFrame,
    seed: int,
    floor: float = 100.0,
    age_cap: int | None = None,
    added: Sequence[str] = INCOME_ADDED,
    subtracted: Sequence[str] = INCOME_SUBTRACTED,
    dependants: Sequence[str] = ("dep_age1", "dep_age2", "dep_age3"),
    store: bool = False,
) -> DataFrame:
    """id, weight, age, married, has_kids, income_pctile.

    Binning reads its input several times; with ``store`` the narrow rows are stored before it, so
    that a wide or slow source is read once.
    """
    child = [F.col(c).isNotNull() & (F.col(c) <= CHILD_AGE) for c in dependants]
    df = unit_income(df, added, subtracted).select(
        "id",
        "weight",
        F.col("age1").alias("age"),
        (F.col("filing_status") == MARRIED_FILING).cast("int").alias("married"),
        reduce(lambda a, b: a | b, child).cast("int").alias("has_kids"),
        "income",
    )
    df = rank_bins(materialise(df) if store else df, "income", "weight", seed, floor)
    return cap_age(df.drop("income"), age_cap)
