import numpy as np
import pytest
from pyspark.sql import functions as F

from heirflow.operators import projection
from heirflow.sources import sinks


@pytest.fixture(scope="module")
def units(spark):
    values = np.random.default_rng(3).lognormal(14, 1.5, 300)
    rows = [(i, 0.1, float(v)) for i, v in enumerate(values)] + [(300, 0.1, None)]
    return spark.createDataFrame(rows, "id long, p_inheritance double, inheritance double")


def test_liability(spark, units):
    out = projection.scenario_liability(units, {"low": 7.2e6, "high": 15e6}, 2.8)
    rows = out.collect()
    assert rows[-1]["low_tax"] is None
    for r in rows[:-1]:
        assert r["low_tax"] == pytest.approx(max(0.0, r["inheritance"] * 2.8 - 7.2e6) * 0.4 / 2.8)
        assert r["high_tax"] <= r["low_tax"]
    delta = projection.scenario_delta(out, "low", "high")
    assert delta.agg(F.min("estate_tax_change")).first()[0] >= 0


def test_at_the_exemption_nothing_is_due(spark):
    df = spark.createDataFrame([(1, 1.0, 2.5e6)], "id long, p_inheritance double, inheritance double")
    assert projection.scenario_liability(df, {"x": 7e6}, 2.8).first()["x_tax"] == 0.0


@pytest.fixture(scope="module")
def indexes(spark):
    rows = [(y, 1.02 ** (y - 2026), 1.03 ** (y - 2026)) for y in range(2026, 2056)]
    return spark.createDataFrame(rows, "year int, inflation_index double, gdp_pc_index double")


EXEMPTIONS = {"baseline": 7.2e6, "tcja": 14.3e6}


def test_exemptions_follow_prices(indexes):
    row = projection.indexed_exemptions(indexes, EXEMPTIONS).where("year = 2027").first()
    assert row["baseline_exemption"] == pytest.approx(7.2e6 * 1.02)
    assert row["tcja_exemption"] == pytest.approx(14.3e6 * 1.02)


def test_projection_is_one_narrow_pass(units, indexes):
    parameters = projection.scenario_years(indexes, EXEMPTIONS)
    assert len(parameters) == 60
    out = projection.project_scenarios(units, parameters, 2.8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.count() == 60 * 301
    row = out.where("scenario = 'tcja' and year = 2030 and id = 5").first()
    start = units.where("id = 5").first()["inheritance"]
    assert row["inheritance"] == pytest.approx(start * 1.03**4)
    due = max(0.0, row["inheritance"] * 2.8 - 14.3e6 * 1.02**4) * 0.4 / 2.8
    assert row["estate_tax_liability"] == pytest.approx(due)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_sink(spark, units, indexes, tmp_path, kind):
    out = projection.project_scenarios(units, projection.scenario_years(indexes, EXEMPTIONS), 2.8)
    folder = sinks.run_folder(str(tmp_path), "2026120112")
    sinks.write_scenarios(out, folder, kind)
    assert (tmp_path / "2026120112" / "scenario=baseline" / "year=2055").is_dir()
    back = sinks.read_scenarios(spark, folder, kind)
    assert back.exceptAll(out).count() == 0 and out.exceptAll(back).count() == 0
    one = back.where("scenario = 'baseline' and year = 2030")
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 301
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_scenarios(out, folder, kind)


def test_records_of_one_partition_are_dealt_before_they_are_projected(units, indexes):
    parameters = projection.scenario_years(indexes, EXEMPTIONS)
    one = units.coalesce(1)
    out = projection.project_scenarios(projection.dealt(one, parameters, 3000), parameters, 2.8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * 3000
    plain = projection.project_scenarios(one, parameters, 2.8)
    assert out.exceptAll(plain).count() == 0 and out.count() == 60 * 301
    assert "Exchange" not in projection.dealt(one, parameters)._jdf.queryExecution().executedPlan().toString()


def test_change_by_year_is_the_difference_of_the_scenarios(units, indexes):
    parameters = projection.scenario_years(indexes, EXEMPTIONS)
    changes = projection.project_changes(units, parameters, "baseline", "tcja", 2.8)
    assert changes.columns == ["id", "year", "estate_tax_change"] and changes.count() == 30 * 301
    both = projection.project_scenarios(units, parameters, 2.8).groupBy("id", "year").pivot(
        "scenario", ["baseline", "tcja"]
    ).agg(F.first("estate_tax_liability"))
    joined = changes.join(both, ["id", "year"])
    gap = F.abs(F.col("estate_tax_change") - (F.col("baseline") - F.col("tcja")))
    assert joined.agg(F.max(gap)).first()[0] < 1e-6
    assert changes.where("id = 300").agg(F.count("estate_tax_change")).first()[0] == 0


def test_year_without_an_index_is_named(spark):
    rows = [(2026, 1.0, 1.0), (2027, None, 1.1)]
    table = spark.createDataFrame(rows, "year int, inflation_index double, gdp_pc_index double")
    with pytest.raises(ValueError, match="2027"):
        projection.scenario_years(table, EXEMPTIONS)


def test_any_scenario_name(units):
    name = "o'b \\ x"
    out = projection.project_scenarios(units.limit(3), [(name, 2026, 1.0, 7e6)], 2.8)
    assert {r["scenario"] for r in out.collect()} == {name}


def test_files_of_a_cell_are_bounded(spark, units, indexes, tmp_path):
    parameters = projection.scenario_years(indexes.where("year < 2029"), EXEMPTIONS)
    projected = projection.project_scenarios(units.repartition(20), parameters, 2.8)
    folder = str(tmp_path / "few")
    sinks.write_scenarios(projected, folder, files=2)
    cells = list((tmp_path / "few").glob("scenario=*/year=*"))
    assert len(cells) == 6 and all(1 <= len(list(c.glob("*.parquet"))) <= 2 for c in cells)
    assert sinks.read_scenarios(spark, folder).count() == 6 * 301


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_a_cell_can_be_written_again(spark, units, indexes, tmp_path, kind):
    parameters = projection.scenario_years(indexes.where("year < 2030"), EXEMPTIONS)
    projected = projection.project_scenarios(units.repartition(9), parameters, 2.8)
    folder = str(tmp_path / "run")
    sinks.write_scenarios(projected, folder, kind)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "run").glob("scenario=*/year=*/part-*")}
    before = files()
    again = projected.where("year = 2027 AND scenario = 'baseline'").withColumn("inheritance", F.lit(1.0))
    for _ in range(2):
        sinks.rewrite_cells(again, folder, kind)
    after = files()
    cell = lambda p: "scenario=baseline/year=2027" in str(p)
    assert {p: t for p, t in before.items() if not cell(p)} == {p: t for p, t in after.items() if not cell(p)}
    assert len([p for p in after if cell(p)]) == 1 and not set(filter(cell, before)) & set(after)
    back = sinks.read_scenarios(spark, folder, kind)
    assert back.count() == projected.count()
    assert back.where("inheritance = 1.0").count() == 301 == back.where("year = 2027 AND scenario = 'baseline'").count()
