"""Constant arrays, and binary search over a sorted array column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_literal(value: float) -> str:
    """SQL text of a finite double."""
    return f"{float(value)!r}D"


def doubles(values: Sequence[float]) -> Column:
    """Constant array of doubles, parsed once instead of built literal by literal."""
    entries = ", ".join(double_literal(v) for v in values)
    return F.expr(f"array({entries})" if entries else "cast(array() as array<double>)")


def integers(values: Sequence[int]) -> Column:
    """Constant array of integers."""
    return F.expr(f"cast(array({', '.join(str(int(v)) for v in values)}) as array<int>)")


def count_below(df: DataFrame, value: Column, breaks: Column, longest: int, out: str) -> DataFrame:
    """Add ``out``: how many entries of the ascending array ``breaks`` are below ``value``.

    ``longest`` bounds the array length. Each halving step is one projection, so
    the search is compiled code with log2(longest) comparisons per row and works
    with a different array on every row. A null value or array counts 0.
    """
    step = 1 << (max(longest, 1).bit_length() - 1)
    df = df.withColumn(out, F.lit(0))
    while step:
        reached = F.get(breaks, F.col(out) + F.lit(step - 1))
        df = df.withColumn(out, F.col(out) + F.when(reached < value, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return df
