"""From input files to tax by scenario and year."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirflow.operators import calibrate, macro, models, projection, survey
from heirflow.operators.forest import Forest
from heirflow.operators.lookup import settled
from heirflow.operators.ordered import rank_bins, weighted_resample
from heirflow.operators.reshape import demographic_long, numbered
from heirflow.operators.units import unit_features
from heirflow.sources import readers, sinks
from heirflow.sources.schemas import INCOME_ADDED, INCOME_SUBTRACTED
from heirflow.sources.shared import fresh_path, materialise, scratch


#: What the forest, the regressions, the targets and the distribution of amounts read of a drawn record.
SAMPLE_COLUMNS = ("age", "married", "income_pctile", "has_inheritance", "inheritance", "weight")


@dataclass(frozen=True)
class Settings:
    """Everything a run can vary; the defaults are the reference's values."""

    waves: tuple[int, ...] = survey.WAVES
    timing: tuple[tuple[int, int, float], ...] = survey.TIMING
    copies: int = 5
    anchor: int = 2026
    last_known: int = 2023
    years: tuple[int, int] = (2026, 2055)
    sample: int = 500_000
    survey_age_cap: int | None = 80
    unit_age_cap: int | None = None
    survey_floor: float = 1000.0
    unit_floor: float = 100.0
    seed: int = 123
    fit_seed: int = 8
    trees: int = 100
    depth: int = 30
    min_leaf: int = 50
    p_cap: float | None = None
    # units past the oldest surveyed age group have no target; they keep the chance of the forest
    missing_target: str = "keep"
    harvey_correction: bool = False
    heirs: float = calibrate.HEIRS_PER_ESTATE
    brackets: tuple[calibrate.Bracket, ...] = calibrate.ESTATE_BRACKETS
    exemptions: dict[str, float] = field(
        default_factory=lambda: {**projection.BASELINE, "tcja": projection.REFORMS["tcja"]}
    )
    added: tuple[str, ...] = INCOME_ADDED
    subtracted: tuple[str, ...] = INCOME_SUBTRACTED


@dataclass(frozen=True)
class Macro:
    economic: DataFrame
    demographic: DataFrame
    net_worth: DataFrame


def macro_tables(wide: DataFrame, quarterly: DataFrame, s: Settings) -> Macro:
    """Economic series, population by cell, and net worth per head."""
    wide = settled(wide)
    economic, demographic = settled(macro.economic(wide)), settled(demographic_long(wide))
    net_worth = macro.net_worth_per_capita(
        quarterly, economic, demographic, min(s.waves), s.last_known, s.anchor
    )
    return Macro(economic, demographic, settled(net_worth))


def training_table(surveys: DataFrame, m: Macro, s: Settings) -> DataFrame:
    """Survey rows aged to the anchor year, with inheritance and income rank.

    ``surveys`` are the assembled waves, one row per record. Records are stored; their copies are made and drawn when read.
    """
    # Copies differ in their draws only: weights grow and incomes are binned once a record, counted as ``copies`` rows.
    events = [f"{measure}_{n}" for n in (1, 2, 3) for measure in ("type", "value", "year")]
    df = surveys.withColumn("weight", F.col("weight") / F.lit(float(s.copies)))
    df = survey.age_weights(df, m.demographic, s.anchor)
    df = df.withColumn("_all", F.col("weight") * F.lit(float(s.copies))).select(
        "survey_year", "yy1", "y1", "weight", "_all", "age", "married", "has_kids", "income", *events
    )
    # Stored: binning reads the rows four times and would repeat the survey join each time.
    df = rank_bins(materialise(df), "income", "_all", s.seed, s.survey_floor, by=["survey_year"])
    # Stored again: the copies are drawn from it whenever they are read, which costs less than storing them.
    df = materialise(df.drop("income", "_all"))
    df = survey.with_inheritance(numbered(df, s.copies), s.seed, s.timing).select(
        "survey_year", "age", "married", "yy1", "y1", "dup_id", "weight", "has_kids",
        "inheritance", "has_inheritance", "income_pctile",
    )
    return survey.cap_age(survey.age_values(df, m.net_worth, s.anchor), s.survey_age_cap)


def training_sample(table: DataFrame, s: Settings) -> DataFrame:
    """Equal-weight sample with the columns that models and targets read, stored because they all read it."""
    return materialise(weighted_resample(table, "weight", survey.SURVEY_KEY, s.sample, s.seed, columns=SAMPLE_COLUMNS))


def score_units(
    units: DataFrame,
    sample: DataFrame,
    forest: Forest,
    s: Settings,
) -> DataFrame:
    """Raked chance and lognormal amount for each unit of ``unit_features``."""
    scored = materialise(models.forest_probability(units, forest))
    targets = calibrate.rake_targets(sample, len(s.waves))
    raked = calibrate.rake(scored, targets, cap=s.p_cap, missing_target=s.missing_target)
    amounts = models.fit_amounts(sample, harvey_correction=s.harvey_correction)
    return models.impute_amounts(models.predict_amounts(raked, amounts), s.fit_seed)


def calibrate_units(scored: DataFrame, sample: DataFrame, s: Settings) -> DataFrame:
    """Amounts matched to the survey distribution, then calibrated by bracket."""
    scored = materialise(scored.withColumn("expected", F.col("weight") * F.col("p_inheritance")))
    factors = calibrate.quantile_factors(
        sample.withColumn("one", F.lit(1.0)), scored, "one", "expected"
    )
    matched = calibrate.match_quantiles(scored.drop("expected"), factors)
    return calibrate.calibrate_brackets(matched, s.fit_seed, s.brackets, s.heirs)


@dataclass(frozen=True)
class Inputs:
    """Where the input files are."""

    macro_root: str
    survey_root: str
    tax_units: str
    net_worth: str
    macro_files: tuple[str, ...] = ("projections.csv", "historical.csv")
    tax_units_kind: str = "csv"


def simulate(
    spark: SparkSession,
    inputs: Inputs,
    output_root: str,
    run_id: str,
    settings: Settings = Settings(),
    estimate: bool = True,
    forest_path: str | None = None,
    kind: str = "csv",
) -> DataFrame:
    """Run everything, write scenario files under ``output_root/run_id``, return the final units.

    The units are stored under ``output_root/run_id-units``; all other steps are deleted at the end.
    With ``estimate`` off the forest stored at ``forest_path`` is reused.
    """
    units_path = sinks.run_folder(output_root, f"{run_id}-units")
    with scratch(spark):
        final, indexes = _final_units(spark, inputs, settings, estimate, forest_path, units_path)
        parameters = projection.scenario_years(indexes, settings.exemptions)
        projected = projection.project_scenarios(projection.dealt(final, parameters), parameters, settings.heirs)
        sinks.write_scenarios(projected, sinks.run_folder(output_root, run_id), kind)
    return final


def _final_units(
    spark: SparkSession,
    inputs: Inputs,
    s: Settings,
    estimate: bool,
    forest_path: str | None,
    units_path: str,
) -> tuple[DataFrame, DataFrame]:
    """(units stored at ``units_path``, indexes by year)."""
    m = macro_tables(
        readers.read_macro(spark, inputs.macro_root, inputs.macro_files),
        readers.read_net_worth(spark, inputs.net_worth),
        s,
    )
    surveys = survey.assemble_survey(*readers.read_survey(spark, inputs.survey_root, s.waves))
    sample = training_sample(training_table(surveys, m, s), s)
    forest = models.saved_forest(
        sample, forest_path or fresh_path(spark, "forest"), estimate, s.seed,
        trees=s.trees, depth=s.depth, min_leaf=s.min_leaf,
    )
    raw = readers.read_tax_units(spark, inputs.tax_units, inputs.tax_units_kind)
    units = unit_features(raw, s.seed, s.unit_floor, s.unit_age_cap, s.added, s.subtracted, store=True)
    final = calibrate_units(score_units(units, sample, forest, s), sample, s)
    final.write.parquet(units_path)
    final = spark.read.schema(final.schema).parquet(units_path)
    return final, macro.projection_indexes(m.economic, m.demographic, *s.years, s.anchor)
