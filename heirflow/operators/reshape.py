"""Wide and long layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate(df: DataFrame, copies: int, weight: str = "weight", out: str = "dup_id") -> DataFrame:
    """``copies`` rows for each, numbered from 1, sharing the weight equally."""
    return numbered(df.withColumn(weight, F.col(weight) / F.lit(float(copies))), copies, out)


def numbered(df: DataFrame, copies: int, out: str = "dup_id") -> DataFrame:
    """``copies`` equal rows for each, numbered from 1."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(copies))))


def demographic_long(wide: DataFrame, token: str = "married") -> DataFrame:
    """Columns ``<status>_<age>`` to rows (year, married, age, population).

    Takes every column whose name contains ``token``; drops the age 'NA'.
    """
    cells = [c for c in wide.columns if token in c]
    # One array per row instead of unpivot, whose plan repeats the row once per column.
    values = F.array(*[F.col(c).cast("double") for c in cells])
    long = wide.select("year", F.posexplode(values).alias("pos", "population")).withColumn(
        "cell", F.get(F.lit(cells), F.col("pos"))
    )
    status, age = F.split("cell", "_")[0], F.split("cell", "_")[1]
    return (
        long.where(age != "NA")
        .select(
            "year",
            (status == token).cast("int").alias("married"),
            age.try_cast("int").alias("age"),
            "population",
        )
    )


def events_long(df: DataFrame, keys: Sequence[str], events: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``type_n, value_n, year_n`` to one row per event: keys, n, type, value, year."""
    entries = [
        F.struct(
            F.lit(n).alias("n"),
            F.col(f"type_{n}").alias("type"),
            F.col(f"value_{n}").alias("value"),
            F.col(f"year_{n}").alias("year"),
        )
        for n in events
    ]
    return df.select(*keys, F.inline(F.array(*entries)))


def events_wide(
    df: DataFrame, keys: Sequence[str], events: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """Events with ``value`` and ``p`` to one row per key: value_1, p_1, value_2, ..."""
    wide = (
        df.groupBy(*keys)
        .pivot("n", list(events))
        .agg(F.first("value").alias("value"), F.first("p").alias("p"))
    )
    return wide.withColumnsRenamed(
        {f"{n}_{m}": f"{m}_{n}" for n in events for m in ("value", "p")}
    )
