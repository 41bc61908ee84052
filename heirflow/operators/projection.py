"""Tax by scenario and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.functions.arrays import double_literal
from heirflow.functions.nulls import greatest_or_null

TAX_RATE = 0.4
#: Projected rows that one task makes, about.
ROWS_PER_TASK = 1_000_000

# Exemption in the anchor year and output folder of each regime.
BASELINE = {"baseline": 7.2e6}
REFORMS = {"tcja": 14.3e6, "obbba": 15e6, "tcja_ext": 14e6}


def liability(value: Column, exemption: Column, heirs: float, rate: float = TAX_RATE) -> Column:
    """Tax on the estate behind an inheritance, per heir."""
    taxable = greatest_or_null(F.lit(0.0), value * F.lit(heirs) - exemption)
    return taxable * F.lit(rate) / F.lit(heirs)


def scenario_liability(
    df: DataFrame,
    exemptions: Mapping[str, float],
    heirs: float,
    rate: float = TAX_RATE,
    value: str = "inheritance",
) -> DataFrame:
    """Add ``<scenario>_tax`` for each exemption."""
    return df.withColumns(
        {
            f"{name}_tax": liability(F.col(value), F.lit(exemption), heirs, rate)
            for name, exemption in exemptions.items()
        }
    )


def scenario_delta(df: DataFrame, baseline: str, reform: str, out: str = "estate_tax_change") -> DataFrame:
    """Add baseline tax less reform tax."""
    return df.withColumn(out, F.col(f"{baseline}_tax") - F.col(f"{reform}_tax"))


def indexed_exemptions(indexes: DataFrame, exemptions: Mapping[str, float]) -> DataFrame:
    """year and ``<scenario>_exemption``: the anchor-year exemption grown with prices."""
    return indexes.select(
        "year",
        *[
            (F.lit(amount) * F.col("inflation_index")).alias(f"{name}_exemption")
            for name, amount in exemptions.items()
        ],
    )


def scenario_years(
    indexes: DataFrame, exemptions: Mapping[str, float], max_rows: int = 10_000
) -> list[tuple[str, int, float, float]]:
    """(scenario, year, growth, exemption) for every scenario and year of ``indexes``."""
    table = indexes.select("year", "gdp_pc_index", "inflation_index").orderBy("year")
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} projection years")
    for r in rows:
        if r["gdp_pc_index"] is None or r["inflation_index"] is None:
            raise ValueError(f"no index for year {r['year']}")
    return [
        (name, r["year"], r["gdp_pc_index"], amount * r["inflation_index"])
        for name, amount in exemptions.items()
        for r in rows
    ]


def _text(value: str) -> str:
    """SQL text of a string."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def project_changes(
    df: DataFrame,
    parameters: Sequence[tuple[str, int, float, float]],
    baseline: str,
    reform: str,
    heirs: float,
    rate: float = TAX_RATE,
) -> DataFrame:
    """id, year, estate_tax_change: baseline tax less reform tax of every record in every year, one narrow pass."""
    by_year = {(name, year): (growth, exemption) for name, year, growth, exemption in parameters}
    years = sorted({year for name, year in by_year if name == baseline})
    entries = ", ".join(
        f"struct({year} AS year, {double_literal(by_year[baseline, year][0])} AS _growth, "
        f"{double_literal(by_year[baseline, year][1])} AS _before, "
        f"{double_literal(by_year[reform, year][1])} AS _after)"
        for year in years
    )
    grown = df.select("id", "inheritance", F.expr(f"inline(array({entries}))"))
    value = F.col("inheritance") * F.col("_growth")
    change = liability(value, F.col("_before"), heirs, rate) - liability(value, F.col("_after"), heirs, rate)
    return grown.select("id", "year", change.alias("estate_tax_change"))


def dealt(
    df: DataFrame, parameters: Sequence[tuple[str, int, float, float]], most_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """id, p_inheritance, inheritance, dealt over enough partitions for about ``most_rows`` projected rows each.

    A write by cell sorts whatever a task projects, and one file or join may leave all records in one task. Records are
    dealt before they are exploded over the cells. Counts ``df``; a table that is small enough stays where it is.
    """
    df = df.select("id", "p_inheritance", "inheritance")
    tasks = -(-df.count() * len(parameters) // most_rows)
    return df.repartition(tasks) if tasks > 1 else df


def project_scenarios(
    df: DataFrame,
    parameters: Sequence[tuple[str, int, float, float]],
    heirs: float,
    rate: float = TAX_RATE,
) -> DataFrame:
    """Every record under every (scenario, year): grown inheritance and tax.

    The parameters are a constant array that each record is exploded over, so
    the whole projection is one narrow pass.
    """
    entries = ", ".join(
        f"struct({_text(scenario)} AS scenario, {year} AS year, "
        f"{double_literal(growth)} AS _growth, {double_literal(exemption)} AS _exemption)"
        for scenario, year, growth, exemption in parameters
    )
    grown = df.select(
        "id", "p_inheritance", "inheritance", F.expr(f"inline(array({entries}))")
    ).withColumn("inheritance", F.col("inheritance") * F.col("_growth"))
    tax = liability(F.col("inheritance"), F.col("_exemption"), heirs, rate)
    return grown.select(
        "scenario", "year", "id", "p_inheritance", "inheritance", tax.alias("estate_tax_liability")
    )
