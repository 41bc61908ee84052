"""Aligning imputed chances and amounts to known totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.functions.arrays import count_below, doubles
from heirflow.functions.draws import pareto
from heirflow.functions.nulls import required
from heirflow.operators.lookup import lookup_join, settled
from heirflow.operators.ordered import weighted_quantiles, weighted_rank
from heirflow.operators.projection import liability
from heirflow.sources.shared import materialise

HEIRS_PER_ESTATE = 2.8
QUANTILE_STEPS = 1000
CELL = ("married", "age_group")


def age_group(age: str = "age", width: int = 5) -> Column:
    """Lower end of the age group."""
    return (F.floor(F.col(age) / F.lit(float(width))) * width).cast("int")


def rake_targets(
    df: DataFrame, waves: int, value: str = "inheritance", weight: str = "weight"
) -> DataFrame:
    """Weighted number of records with a positive value per cell, averaged over waves."""
    positive = required((F.col(value) > 0).cast("double"), value)
    return (
        df.withColumn("age_group", age_group())
        .groupBy(*CELL)
        .agg(F.sum(positive * required(F.col(weight), weight) / F.lit(float(waves))).alias("actual"))
    )


def rake(
    df: DataFrame,
    targets: DataFrame,
    p: str = "p_inheritance",
    weight: str = "weight",
    cap: float | None = None,
    missing_target: str = "null",
) -> DataFrame:
    """Scale ``p`` so that its weighted sum in each cell meets the target.

    Cell sums are aggregated and joined back, so a cell with a third of all rows
    is never gathered. ``cap`` limits p. A cell without a target gets null
    (``missing_target`` "null"), keeps its chances ("keep") or stops the job ("error").
    """
    if missing_target not in ("null", "keep", "error"):
        raise ValueError(f"missing_target {missing_target!r}")
    df = df.withColumn("age_group", age_group())
    mass = required(F.col(p), p) * required(F.col(weight), weight)
    cells = df.groupBy(*CELL).agg(F.sum(mass).alias("_mass"))
    factors = lookup_join(cells, targets, CELL).select(
        *CELL, F.try_divide("actual", "_mass").alias("_factor")
    )
    factor = F.col("_factor")
    if missing_target == "keep":
        factor = F.coalesce(factor, F.lit(1.0))
    elif missing_target == "error":
        factor = required(factor, "target of a cell")
    raked = F.col(p) * factor
    if cap is not None:
        raked = F.when(raked > F.lit(cap), F.lit(cap)).otherwise(raked)
    return lookup_join(df, factors, CELL).withColumn(p, raked).drop("_factor")


def quantile_factors(
    actual: DataFrame,
    predicted: DataFrame,
    actual_weight: str,
    predicted_weight: str,
    value: str = "inheritance",
    steps: int = QUANTILE_STEPS,
) -> DataFrame:
    """rank (0..steps) and factor: quantile of the actual over that of the predicted values."""
    probs = [i / steps for i in range(steps + 1)]

    def grid(df: DataFrame, weight: str, name: str) -> DataFrame:
        positive = df.where(F.col(value) > 0)
        found = weighted_quantiles(positive, value, weight, probs)
        return settled(
            found.select(F.col("prob_index").alias("rank"), F.col("quantile").alias(name))
        )

    both = grid(actual, actual_weight, "actual").join(
        F.broadcast(grid(predicted, predicted_weight, "predicted")), "rank", "left"
    )
    return both.withColumn("factor", F.try_divide("actual", "predicted"))


def match_quantiles(
    df: DataFrame,
    factors: DataFrame,
    key: Sequence[str] = ("id",),
    value: str = "inheritance",
    rank_weight: str = "weight",
    steps: int = QUANTILE_STEPS,
) -> DataFrame:
    """Multiply each value by the factor at its weighted rank; ``factors`` has steps + 1 rows."""
    ranked = weighted_rank(df, value, rank_weight, key, steps)
    return (
        lookup_join(ranked, factors.select("rank", "factor"), ["rank"])
        .withColumn(value, F.col(value) * F.col("factor"))
        .drop("rank", "factor")
    )


@dataclass(frozen=True)
class Bracket:
    """Estates between two sizes: how many there are and their average, in dollars."""

    low: float
    high: float | None
    count: float
    average: float


# Estate-tax targets by gross estate.
ESTATE_BRACKETS = (
    Bracket(5e6, 10e6, 3200, 7.5e6),
    Bracket(10e6, 20e6, 1600, 15e6),
    Bracket(20e6, 50e6, 1200, 30e6),
    Bracket(50e6, None, 500, 175e6),
)


def per_heir(brackets: Sequence[Bracket], heirs: float) -> list[Bracket]:
    """The same targets in inheritances instead of estates."""
    return [
        Bracket(
            b.low / heirs,
            None if b.high is None else b.high / heirs,
            b.count * heirs,
            b.average / heirs,
        )
        for b in brackets
    ]


@dataclass(frozen=True)
class Promotion:
    """Which rows below a bracket may be lifted into it, and how high."""

    most: int = 100
    percentile: float = 0.95
    alpha: float = 1.5


def _inside(value: Column, bracket: Bracket) -> Column:
    inside = value >= F.lit(bracket.low)
    return inside if bracket.high is None else inside & (value < F.lit(bracket.high))


def _promoted(
    df: DataFrame, bracket: Bracket, deficit: float, seed: int, draw: str, rule: Promotion, id: str, value: str, p: str, weight: str
) -> list[tuple]:
    """(id, value, chance) of the rows that :func:`promote` lifts, ``rule.most`` at most."""
    lifted = pareto(bracket.average, rule.alpha, F.col(id), seed=seed, draw=draw)
    top = (
        df.where(F.col(value) < F.lit(bracket.low))
        .orderBy(F.desc(value), id)
        .limit(rule.most)
        .select(id, value, p, weight, lifted.alias("lifted"))
        .collect()
    )
    values = sorted({r[value] for r in top})
    if not values:
        return []
    # How many rows are at or below each candidate value tells which ones reach the
    # percentile: one narrow pass, no sort of the table.
    present = df.select(value).where(F.col(value).isNotNull())
    placed = count_below(present, F.col(value), doubles(values), len(values), "step")
    tally = {r["step"]: r["count"] for r in placed.groupBy("step").count().collect()}
    at_or_below = dict(zip(values, np.cumsum([tally.get(i, 0) for i in range(len(values))]).tolist()))
    position = 1.0 + (sum(tally.values()) - 1) * rule.percentile
    enough = int(np.ceil(position))
    chosen = [r for r in top if at_or_below[r[value]] >= enough]
    if not chosen:
        return []
    ids = [r[id] for r in chosen]
    if None in ids or df.where(F.col(id).isin(ids)).count() != len(ids):
        raise ValueError(f"{id} of a promoted row is null or repeated")
    headroom = sum((1.0 - r[p]) * r[weight] for r in chosen)
    share = min(1.0, deficit / headroom) if headroom > 0 else 0.0
    return [(r[id], r["lifted"], r[p] + share * (1.0 - r[p])) for r in chosen]


def _changed(df: DataFrame, changes: Sequence[tuple], id: str, value: str, p: str) -> DataFrame:
    """``df`` with value and chance of the few rows in ``changes``."""
    if not changes:
        return df
    kind = df.schema[id].dataType.simpleString()
    changed = df.sparkSession.createDataFrame(list(changes), f"`{id}` {kind}, _value double, _p double")
    return (
        df.join(F.broadcast(changed), id, "left")
        .withColumn(value, F.coalesce("_value", value))
        .withColumn(p, F.coalesce("_p", p))
        .drop("_value", "_p")
    )


def promote(
    df: DataFrame,
    bracket: Bracket,
    deficit: float,
    seed: int,
    draw: str,
    rule: Promotion = Promotion(),
    id: str = "id",
    value: str = "inheritance",
    p: str = "p_inheritance",
    weight: str = "weight",
) -> DataFrame:
    """Lift the largest values below the bracket into it until ``deficit`` is met.

    Candidates are at or above the unweighted percentile of all values that are
    there. The top ``rule.most`` get a Pareto value above the bracket average and a
    chance raised in proportion to its headroom. A chosen id must be of one row.
    """
    return _changed(df, _promoted(df, bracket, deficit, seed, draw, rule, id, value, p, weight), id, value, p)


def _first_reaching(bound: float, factor: float) -> float:
    """The least double whose product with ``factor`` is at or above ``bound``."""
    x = bound / factor
    while x * factor >= bound:
        x = float(np.nextafter(x, -np.inf))
    while x * factor < bound:
        x = float(np.nextafter(x, np.inf))
    return x


@dataclass
class BracketMap:
    """What brackets did so far: intervals of the original value with factors for value and chance, and promoted rows.

    Interval i begins at ``starts[i]``; a chance that has a factor is 1 at most.
    """

    starts: list[float] = field(default_factory=lambda: [-np.inf])
    values: list[float] = field(default_factory=lambda: [1.0])
    chances: list[float] = field(default_factory=lambda: [1.0])
    promoted: dict = field(default_factory=dict)

    def _cut(self, bound: float) -> None:
        """Let no interval hold mapped values on both sides of ``bound``."""
        for i in range(len(self.starts) - 1, -1, -1):
            end = self.starts[i + 1] if i + 1 < len(self.starts) else np.inf
            at = _first_reaching(bound, self.values[i])
            if self.starts[i] < at < end:
                self.starts.insert(i + 1, at)
                self.values.insert(i + 1, self.values[i])
                self.chances.insert(i + 1, self.chances[i])

    def scale(self, bracket: Bracket, chance: float | None, factor: float) -> None:
        """Multiply values in the bracket by ``factor``, chances by ``chance`` where given."""
        within = lambda x: x >= bracket.low and (bracket.high is None or x < bracket.high)
        for bound in (bracket.low, bracket.high):
            if bound is not None:
                self._cut(bound)
        for i, start in enumerate(self.starts):
            if within(start * self.values[i]):
                self.values[i] *= factor
                self.chances[i] *= 1.0 if chance is None else chance
        for key, (x, p) in self.promoted.items():
            if within(x):
                self.promoted[key] = (x * factor, p if chance is None else min(1.0, p * chance))

    def on(self, df: DataFrame, id: str, value: str, p: str) -> DataFrame:
        """``df`` with everything applied: a search among the intervals and one join with the promoted rows."""
        below = doubles([float(np.nextafter(x, -np.inf)) for x in self.starts[1:]])
        df = count_below(df, F.col(value), below, len(self.starts), "_place")
        factor, chance = (F.get(doubles(x), F.col("_place")) for x in (self.values, self.chances))
        raised = F.when(F.col(value).isNull() | (chance == 1.0), F.col(p)).otherwise(F.least(F.lit(1.0), F.col(p) * chance))
        df = df.withColumns({p: raised, value: F.col(value) * factor}).drop("_place")
        return _changed(df, [(key, *x) for key, x in self.promoted.items()], id, value, p)


def calibrate_brackets(
    df: DataFrame,
    seed: int,
    brackets: Sequence[Bracket] = ESTATE_BRACKETS,
    heirs: float = HEIRS_PER_ESTATE,
    shrink: float = 0.75,
    shrink_above: float = 1e6,
    rule: Promotion = Promotion(),
    tolerance: float = 1e-9,
    id: str = "id",
    value: str = "inheritance",
    p: str = "p_inheritance",
    weight: str = "weight",
) -> DataFrame:
    """Bring expected counts and averages by bracket up to the targets, lowest bracket first.

    Each bracket sees what the one before it did, kept as a :class:`BracketMap` on the driver: a few
    intervals with factors and ``rule.most`` promoted rows a bracket at most. Every pass applies it to the stored
    id, value, chance and weight, so the plan is as deep for the last bracket as for the first; the table itself is never shuffled.
    """
    shrunk = F.when(F.col(value) * F.lit(heirs) > F.lit(shrink_above), F.lit(shrink)).otherwise(1.0)
    df = materialise(df.withColumn(p, required(F.col(p), p) * shrunk).withColumn(value, F.col(value).cast("double")))
    narrow, done = df.select(id, value, p, weight), BracketMap()
    for number, b in enumerate(per_heir(brackets, heirs), start=1):
        inside = _inside(F.col(value), b)
        state = done.on(narrow, id, value, p)

        def totals(chance: Column):
            mass = chance * required(F.col(weight), weight)
            return state.where(inside).agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(mass).alias("count"),
                F.sum(mass * F.col(value)).alias("wealth"),
            ).first()

        now = totals(F.col(p))
        if now["rows"] == 0:
            continue
        ratio = None
        if 0 < now["count"] < b.count:
            ratio = b.count / now["count"]
            now = totals(F.least(F.lit(1.0), F.col(p) * F.lit(ratio)))
        factor = 1.0
        if now["count"] > 0 and now["wealth"] / now["count"] < b.average:
            factor = b.average / (now["wealth"] / now["count"])
        done.scale(b, ratio, factor)
        deficit = b.count - now["count"]
        if deficit > tolerance * b.count:
            state = done.on(narrow, id, value, p)
            lifted = _promoted(state, b, deficit, seed, f"promote{number}", rule, id, value, p, weight)
            done.promoted |= {key: (x, chance) for key, x, chance in lifted}
    return done.on(df, id, value, p)


def bracket_summary(
    df: DataFrame,
    exemptions: dict[str, float],
    edges: Sequence[float] = (5e6, 10e6, 20e6, 50e6),
    heirs: float = HEIRS_PER_ESTATE,
    rate: float = 0.4,
    value: str = "inheritance",
    p: str = "p_inheritance",
    weight: str = "weight",
) -> DataFrame:
    """Expected heirs, amounts and tax by size of gross estate, for each exemption named.

    Groups count from 1 (below the first edge). Amounts are in billions. All
    measures come from one aggregation over at most len(edges) + 2 groups.
    """
    mass = required(F.col(p), p) * required(F.col(weight), weight)
    gross = F.col(value) * F.lit(heirs)
    group = reduce(
        lambda rest, e: F.when(gross < F.lit(e[1]), F.lit(e[0])).otherwise(rest),
        reversed(list(enumerate(edges, start=1))),
        F.when(gross.isNotNull(), F.lit(len(edges) + 1)),
    )
    taxes = {name: liability(F.col(value), F.lit(e), heirs, rate) for name, e in exemptions.items()}
    df = df.select(
        group.alias("gross_estate_group"), mass.alias("_mass"), F.col(value).alias("_value"),
        *[tax.alias(f"_{name}") for name, tax in taxes.items()],
    )
    measures = [
        F.sum("_mass").alias("n_inheritances"),
        (F.sum(F.col("_value") * F.col("_mass")) / F.lit(1e9)).alias("inheritances"),
    ]
    for name in taxes:
        tax = F.col(f"_{name}")
        payers = F.sum((tax > 0).cast("double") * F.col("_mass"))
        measures += [
            (F.sum(tax * F.col("_mass")) / F.lit(1e9)).alias(f"amount_{name}"),
            payers.alias(f"count_heirs_{name}"),
            (payers / F.lit(heirs)).alias(f"count_estates_{name}"),
        ]
    return df.groupBy("gross_estate_group").agg(*measures)
