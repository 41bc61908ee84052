"""Joins to tables that are expected to be small, and values at an anchor year."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from heirflow.sources.shared import materialise

SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20


def _fetch(df: DataFrame, max_rows: int) -> pa.Table | None:
    """All rows, if they are within both bounds; the limit keeps what is fetched small in any case."""
    rows = df.limit(max_rows + 1).toArrow()
    return rows if rows.num_rows <= max_rows and rows.nbytes <= SMALL_BYTES else None


def refuse_repeats(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Stop at a value of ``keys`` that comes more than once in ``df``."""
    found = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if found:
        value = ", ".join(f"{k} {found[0][k]}" for k in keys)
        raise ValueError(f"{what} has {found[0]['count']} rows for {value}")


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a table of constants if it has at most ``max_rows`` rows, else None.

    Like a broadcast this passes the rows through the driver, but only after
    the limit has bounded them, and plans built on the result do not contain
    the work that produced it.
    """
    rows = _fetch(df, max_rows)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def settled(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """The constant table if small, else ``df`` as it is."""
    found = settle(df, max_rows)
    return df if found is None else found


def lookup_join(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Left join to one row per key, refusing a lookup whose keys repeat; null keys match null keys.

    A lookup within the row and byte bounds is broadcast; a larger one is stored, checked and shuffled.
    """
    on = list(on)
    rows = _fetch(lookup, max_rows)
    if rows is None:
        right = materialise(lookup)
        most = right.groupBy(*on).count().agg(F.max("count")).first()[0]
    else:
        right = F.broadcast(df.sparkSession.createDataFrame(rows, lookup.schema))
        counts = rows.group_by(on).aggregate([([], "count_all")])["count_all"]
        most = max(counts.to_pylist(), default=0)
    if most > 1:
        raise ValueError(f"lookup has {most} rows for one value of {on}")
    renamed = right.withColumnsRenamed({k: f"_lookup_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_lookup_{k}")) for k in on])
    rest = [c for c in df.columns if c not in on]
    added = [c for c in right.columns if c not in on]
    return df.join(renamed, same, "left").select(*on, *rest, *added)


def row_at_year(df: DataFrame, year: int) -> Row:
    """The one row of ``df`` for ``year``; none or several is an error."""
    rows = df.where(F.col("year") == year).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"need exactly one row for year {year}, found {len(rows)} or more")
    return rows[0]
