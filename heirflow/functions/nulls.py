"""Missing-value rules.

Spark's ``greatest`` and ``least`` skip nulls and ``sum`` ignores them. In this
work a missing amount must stay missing, and a missing weight is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all_present(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def greatest_or_null(*columns: Column) -> Column:
    """Largest argument; null as soon as one argument is null."""
    return F.when(_all_present(columns), F.greatest(*columns))


def least_or_null(*columns: Column) -> Column:
    """Smallest argument; null as soon as one argument is null."""
    return F.when(_all_present(columns), F.least(*columns))


def required(column: Column, name: str) -> Column:
    """The column itself, failing the job at the first null instead of ignoring it."""
    return F.coalesce(column, F.raise_error(F.lit(f"null in required column {name}")))
