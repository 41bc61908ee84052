"""One query per operator, on the stand-in inputs.

Results that went through exp, ln or a division are rounded, because engines
differ in the last bit there. A quantile between two amounts in cents has at most
five decimals and is rounded to six, so that it never lies half way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirflow.operators import calibrate, macro, models, projection, reshape, survey
from heirflow.operators.forest import forest_distribution, load_forest, save_forest
from heirflow.operators.ordered import (
    RANK_PROBS,
    rank_bins,
    weighted_quantiles,
    weighted_rank,
    weighted_resample,
)
from heirflow.operators.units import unit_features, unit_income
from heirflow.plans import files, simulate
from heirflow.plans import standins as s
from heirflow.sources import readers, sinks
from heirflow.sources.shared import fresh_path, materialise

Query = Callable[[SparkSession, str], DataFrame]

UNIT_FLOOR = 100.0
SURVEY_FLOOR = 1000.0
TREE_DEPTH = 3


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


# Sources and sinks


def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = s.units(spark, sf_dir)
    path = fresh_path(spark, "units")
    units.write.option("header", True).option("nullValue", "NA").csv(path)
    return readers.read_csv(spark, path, units.schema)


def scenario_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.run_folder(fresh_path(spark, "scenarios"), "run1")
    sinks.write_scenarios(_projected(spark, sf_dir, deal=True), path, "csv")
    stored = sinks.read_scenarios(spark, path, "csv")
    return _rounded(stored, inheritance=2, estate_tax_liability=2)


def scenario_sink_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells, of which one year is written again with other amounts."""
    path = sinks.run_folder(fresh_path(spark, "scenarios"), "run1")
    projected = _projected(spark, sf_dir, deal=True)
    sinks.write_scenarios(projected, path)
    again = projected.where(F.col("year") == s.RERUN_YEAR).withColumn("inheritance", F.col("inheritance") * 2)
    sinks.rewrite_cells(again, path)
    return _rounded(sinks.read_scenarios(spark, path), inheritance=2, estate_tax_liability=2)


def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    economic = s.economic(spark, sf_dir)
    projections = economic.where("year >= 1999")
    historical = economic.where("year < 1999").select("ccpiu_irs", "year", "gdp")
    return readers.union_by_name([projections, historical]).orderBy(F.asc_nulls_last("year"))


# Macro


def population_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.population_by_year(s.demographic(spark, sf_dir))


def demographic_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = survey.demographic_factor(s.demographic(spark, sf_dir), s.ANCHOR)
    return _rounded(factor, demographic_factor=10)


def networth_per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(s.net_worth(spark, sf_dir), net_worth_pc=4)


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.projection_indexes(
        s.economic(spark, sf_dir), s.demographic(spark, sf_dir), *s.YEARS, s.ANCHOR
    )


def projection_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_indexes(spark, sf_dir), inflation_index=10, gdp_pc_index=10)


# Survey


def duplicate_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.duplicate(s.survey_summary(spark, sf_dir), 5)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.events_long(s.surveys(spark, sf_dir), ["survey_year", "yy1", "y1"])


def timing_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = survey.timing_probability(F.col("survey_year"), F.col("year"), s.TIMING)
    return _events(spark, sf_dir).withColumn("p", p)


def inheritance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = survey.possible_inheritances(_events(spark, sf_dir), s.TIMING)
    return reshape.events_wide(kept, ["survey_year", "yy1", "y1"])


def inheritance_realise(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = reshape.duplicate(s.surveys(spark, sf_dir), 5)
    drawn = survey.realise(copies, s.SEED, s.TIMING)
    return drawn.where(F.col("inheritance").isNotNull()).select(*survey.SURVEY_KEY, "inheritance")


def age_weights_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.survey_summary(spark, sf_dir)
    aged = survey.age_weights(rows, s.demographic(spark, sf_dir), s.ANCHOR)
    return _rounded(aged.select("survey_year", "yy1", "y1", "age", "married", "weight"), weight=8)


def age_values_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = survey.age_values(s.training_rows(spark, sf_dir), s.net_worth(spark, sf_dir), s.ANCHOR)
    return _rounded(aged.select(*survey.SURVEY_KEY, "inheritance"), inheritance=4)


# Order


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_features(
        s.units(spark, sf_dir), s.SEED, UNIT_FLOOR, None, s.ADDED, s.SUBTRACTED
    )


def income_rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.survey_summary(spark, sf_dir)
    binned = rank_bins(rows, "income", "weight", s.SEED, SURVEY_FLOOR, by=["survey_year"])
    return binned.select("survey_year", "y1", "income", "income_pctile")


def weighted_quantiles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_income(s.units(spark, sf_dir), s.ADDED, s.SUBTRACTED)
    found = weighted_quantiles(units, "income", "weight", RANK_PROBS, by=["filing_status"])
    return _rounded(found, quantile=6)


def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = [i / 1000 for i in range(1001)]
    found = weighted_quantiles(s.imputed_units(spark, sf_dir), "inheritance", "weight", probs)
    return _rounded(found, quantile=6)


def weighted_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = weighted_rank(s.imputed_units(spark, sf_dir), "inheritance", "weight", ["id"])
    return ranked.select("id", "inheritance", "rank")


def weighted_resample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = s.units(spark, sf_dir).select("id", "weight", "age1")
    drawn = weighted_resample(units, "weight", ["id"], units.count(), s.SEED)
    return _rounded(drawn, weight=8)


# Imputation and calibration


def impute_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.imputed_units(spark, sf_dir).select("id", "p_inheritance", "inheritance")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.rake_targets(s.training_rows(spark, sf_dir), len(s.WAVES))


def rake_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_targets(spark, sf_dir), actual=6)


def _rakeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    married = (F.col("filing_status") == 2).cast("int")
    return s.imputed_units(spark, sf_dir).select(
        "id", "weight", F.col("age1").alias("age"), married.alias("married"), "p_inheritance"
    )


def rake_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raked = calibrate.rake(_rakeable(spark, sf_dir), _targets(spark, sf_dir))
    return _rounded(raked.select("id", "married", "age_group", "p_inheritance"), p_inheritance=9)


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = s.training_rows(spark, sf_dir).select("inheritance", F.lit(1.0).alias("one"))
    predicted = s.imputed_units(spark, sf_dir).withColumn(
        "expected", F.col("weight") * F.col("p_inheritance")
    )
    actual = materialise(actual.where(F.col("inheritance") > 0))
    return calibrate.quantile_factors(actual, predicted, "one", "expected")


def quantile_match_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_factors(spark, sf_dir), actual=6, predicted=4, factor=8)


def quantile_match_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = s.imputed_units(spark, sf_dir).select("id", "weight", "inheritance")
    matched = calibrate.match_quantiles(units, _factors(spark, sf_dir))
    return _rounded(matched.select("id", "inheritance"), inheritance=2)


def bracket_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = s.imputed_units(spark, sf_dir).select("id", "weight", "p_inheritance", "inheritance")
    done = calibrate.calibrate_brackets(units, s.FIT_SEED, s.brackets(units), s.HEIRS)
    return _rounded(done, p_inheritance=8, inheritance=2)


def top_k_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = s.imputed_units(spark, sf_dir).select("id", "weight", "p_inheritance", "inheritance")
    bracket = calibrate.per_heir(s.brackets(units), s.HEIRS)[1]
    inside = F.col("inheritance").between(bracket.low, bracket.high)
    inside = inside & (F.col("inheritance") < bracket.high)
    expected = units.where(inside).agg(F.sum(F.col("p_inheritance") * F.col("weight"))).first()[0]
    lifted = calibrate.promote(
        units, bracket, bracket.count - (expected or 0.0), s.FIT_SEED, "promote2"
    )
    return _rounded(lifted, p_inheritance=8, inheritance=2)


def bracket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = calibrate.bracket_summary(
        s.imputed_units(spark, sf_dir), s.EXEMPTIONS, s.EDGES, s.HEIRS
    )
    digits = {c: 9 if c.startswith(("amount", "inher")) else 6 for c in report.columns[1:]}
    return _rounded(report, **digits)


# Projection


def scenario_liability(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxed = projection.scenario_liability(s.imputed_units(spark, sf_dir), s.EXEMPTIONS, s.HEIRS)
    return _rounded(
        taxed.select("id", "inheritance", "baseline_tax", "reform_tax"), baseline_tax=4, reform_tax=4
    )


def scenario_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxed = projection.scenario_liability(s.imputed_units(spark, sf_dir), s.EXEMPTIONS, s.HEIRS)
    delta = projection.scenario_delta(taxed, "baseline", "reform")
    return _rounded(delta.select("id", "estate_tax_change"), estate_tax_change=4)


def indexed_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = projection.indexed_exemptions(_indexes(spark, sf_dir), s.EXEMPTIONS)
    return _rounded(table, baseline_exemption=4, reform_exemption=4)


def _projected(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    parameters = projection.scenario_years(_indexes(spark, sf_dir), s.EXEMPTIONS)
    units = s.imputed_units(spark, sf_dir)
    return projection.project_scenarios(projection.dealt(units, parameters) if deal else units, parameters, s.HEIRS)


def scenario_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_projected(spark, sf_dir), inheritance=2, estate_tax_liability=2)


def projection_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = projection.scenario_years(_indexes(spark, sf_dir), s.EXEMPTIONS)
    changes = projection.project_changes(
        s.imputed_units(spark, sf_dir), parameters, "baseline", "reform", s.HEIRS
    )
    return _rounded(changes, estate_tax_change=2)


# Models


def ols_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = s.imputed_units(spark, sf_dir).select("id", "inheritance")
    rows = _features(spark, sf_dir).join(amounts, "id")
    return _rounded(models.ols_moments(rows, F.ln("inheritance")), moment=6)


def _stand_in_settings(**changes) -> simulate.Settings:
    settings = simulate.Settings(
        waves=s.WAVES,
        timing=s.TIMING,
        anchor=s.ANCHOR,
        last_known=s.LAST_KNOWN,
        years=s.YEARS,
        unit_age_cap=80,
        brackets=s.BRACKETS,
        exemptions=s.EXEMPTIONS,
        added=s.ADDED,
        subtracted=s.SUBTRACTED,
    )
    return replace(settings, **changes)


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, simulate.Settings]:
    """As many draws as the training table has rows."""
    surveys = s.surveys(spark, sf_dir)
    settings = _stand_in_settings(sample=5 * s.survey_summary(spark, sf_dir).count())
    tables = simulate.macro_tables(
        s.macro_wide(spark, sf_dir), s.net_worth_quarterly(spark, sf_dir), settings
    )
    return simulate.training_sample(
        simulate.training_table(surveys, tables, settings), settings
    ), settings


def _scoring_units(spark: SparkSession, sf_dir: str, c: simulate.Settings) -> DataFrame:
    return unit_features(
        s.units(spark, sf_dir), c.seed, c.unit_floor, c.unit_age_cap, c.added, c.subtracted, store=True
    )


def hurdle_value_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, c = _sample(spark, sf_dir)
    fitted = models.fit_amounts(sample)
    predicted = models.predict_amounts(_scoring_units(spark, sf_dir, c), fitted)
    return _rounded(predicted.select("id", "mu_pred", "sigma_pred"), mu_pred=6, sigma_pred=6)


def forest_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, c = _sample(spark, sf_dir)
    forest = models.saved_forest(
        sample, fresh_path(spark, "forest"), True, c.seed, trees=c.trees, depth=c.depth, min_leaf=c.min_leaf
    )
    scored = models.forest_probability(_scoring_units(spark, sf_dir, c), forest)
    return _rounded(scored.select("id", "p_inheritance"), p_inheritance=8)


def _one_tree(sample: DataFrame, c: simulate.Settings):
    """A single tree on all rows with every split point, as SQL can spell it out."""
    return models.fit_forest(sample, c.seed, trees=1, depth=TREE_DEPTH, min_leaf=c.min_leaf, bootstrap=False)


def tree_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, c = _sample(spark, sf_dir)
    scored = models.forest_probability(_scoring_units(spark, sf_dir, c), _one_tree(sample, c))
    return _rounded(scored.select("id", "p_inheritance"), p_inheritance=8)


def reloaded_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances from a tree that was stored and read back."""
    sample, c = _sample(spark, sf_dir)
    path = fresh_path(spark, "tree")
    save_forest(_one_tree(sample, c), path)
    scored = models.forest_probability(_scoring_units(spark, sf_dir, c), load_forest(spark, path))
    return _rounded(scored.select("id", "p_inheritance"), p_inheritance=8)


def tree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, quantiles and share above a bound of the amounts in each unit's leaf of the single tree."""
    sample, c = _sample(spark, sf_dir)
    units = _scoring_units(spark, sf_dir, c).select("id", "age", "married", "income_pctile")
    found = forest_distribution(
        units, _one_tree(sample, c), sample, "has_inheritance", "inheritance", s.DISTRIBUTION_PROBS, [s.DISTRIBUTION_BOUND]
    ).drop("age", "married", "income_pctile")
    return _rounded(found, **{c: 8 if c.startswith("above") else 4 for c in found.columns if c != "id"})


def tree_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the model and the alignment between them, with the single tree."""
    sample, c = _sample(spark, sf_dir)
    scored = simulate.score_units(_scoring_units(spark, sf_dir, c), sample, _one_tree(sample, c), c)
    return _rounded(
        scored.select("id", "p_inheritance", "mu_pred", "sigma_pred", "inheritance"),
        p_inheritance=8, mu_pred=6, sigma_pred=6, inheritance=2,
    )


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, simulate.Settings]:
    sample, c = _sample(spark, sf_dir)
    forest = models.fit_forest(sample, c.seed, trees=c.trees, depth=c.depth, min_leaf=c.min_leaf)
    scored = simulate.score_units(_scoring_units(spark, sf_dir, c), sample, forest, c)
    return scored, sample, c


def hurdle_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _, _ = _scored(spark, sf_dir)
    return _rounded(
        scored.select("id", "p_inheritance", "mu_pred", "sigma_pred", "inheritance"),
        p_inheritance=8, mu_pred=6, sigma_pred=6, inheritance=2,
    )


def calibrated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, sample, c = _scored(spark, sf_dir)
    # Line prices are far below the amounts of ``imputed_units``, so everything is a twentieth.
    small = [
        calibrate.Bracket(b.low / 20, b.high and b.high / 20, b.count, b.average / 20)
        for b in s.brackets(scored)
    ]
    final = simulate.calibrate_units(scored, sample, replace(c, brackets=tuple(small)))
    exemptions = {name: e / 20 for name, e in c.exemptions.items()}
    found = calibrate.bracket_summary(final, exemptions, [e / 20 for e in s.EDGES], c.heirs)
    return _rounded(found, **{
        m: 7 if m.startswith("amount") or m == "inheritances" else 4 for m in found.columns if m != "gross_estate_group"
    })


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stand_in_settings()
    tables = simulate.macro_tables(
        s.macro_wide(spark, sf_dir), s.net_worth_quarterly(spark, sf_dir), c
    )
    aged = simulate.training_table(s.surveys(spark, sf_dir), tables, c)
    return _rounded(aged, weight=8, inheritance=4)


QUERIES: dict[str, Query] = {
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "scenario_sink_roundtrip": scenario_sink_roundtrip,
    "scenario_sink_rerun": scenario_sink_rerun,
    "multi_source_union": multi_source_union,
    "macro_files_read": files.macro_files_read,
    "survey_files_read": files.survey_files_read,
    "survey_table_read": files.survey_table_read,
    "cast_failures": files.cast_failures,
    "net_worth_file_read": files.net_worth_file_read,
    "tax_unit_file_read": files.tax_unit_file_read,
    "population_by_year": population_by_year,
    "demographic_long": s.demographic,
    "demographic_factor": demographic_factor,
    "networth_per_capita": networth_per_capita,
    "projection_indexes": projection_indexes,
    "indexed_exemptions": indexed_exemptions,
    "survey_waves": s.surveys,
    "duplicate_reweight": duplicate_reweight,
    "inheritance_events": _events,
    "timing_probability": timing_probability,
    "inheritance_wide": inheritance_wide,
    "inheritance_realise": inheritance_realise,
    "training_frame": s.training_rows,
    "age_weights_forward": age_weights_forward,
    "age_values_forward": age_values_forward,
    "training_table": training_table,
    "unit_features": _features,
    "income_rank_bins": income_rank_bins,
    "weighted_quantiles": weighted_quantiles_by_group,
    "quantile_grid": quantile_grid,
    "weighted_rank": weighted_rank_query,
    "weighted_resample": weighted_resample_query,
    "impute_amounts": impute_amounts,
    "rake_targets": rake_targets,
    "rake_to_targets": rake_to_targets,
    "quantile_match_factors": quantile_match_factors,
    "quantile_match_apply": quantile_match_apply,
    "bracket_calibrate": bracket_calibrate,
    "top_k_promotion": top_k_promotion,
    "bracket_summary": bracket_summary,
    "scenario_liability": scenario_liability,
    "scenario_delta": scenario_delta,
    "scenario_projection": scenario_projection,
    "projection_delta": projection_delta,
    "ols_moments": ols_moments,
    "hurdle_value_model": hurdle_value_model,
    "forest_probability": forest_probability,
    "tree_probability": tree_probability,
    "reloaded_tree": reloaded_tree,
    "tree_distribution": tree_distribution,
    "tree_impute": tree_impute,
    "hurdle_impute": hurdle_impute,
    "calibrated_summary": calibrated_summary,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected heirs, amounts and tax by size of estate under two regimes."""
    return bracket_summary(spark, sf_dir)
