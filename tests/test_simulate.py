"""A whole run on small files in the real layout."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from heirflow.operators.calibrate import Bracket
from heirflow.plans.simulate import Inputs, Settings, simulate
from heirflow.sources import readers, sinks
from heirflow.sources.schemas import INCOME_ADDED, INCOME_SUBTRACTED, TRANSFER_COLUMNS

WAVES = (2013, 2016, 2019, 2022)
YEARS_REPORTED = {2013: (2013, 2010), 2016: (2015, 2015), 2019: (2019, 2018), 2022: (2022, 2020)}


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    rng = np.random.default_rng(11)
    cells = [f"{s}_{a}" for s in ("married", "unmarried") for a in range(18, 97)]

    def macro_row(y):
        return [y, 1e4 * 1.04 ** (y - 2013), 230 + y - 2013, 140 * 1.02 ** (y - 2013)] + [
            1000.0 + 3 * (y - 2013) + k for k in range(len(cells))
        ] + [5.0]

    header = ["year", "gdp", "cpiu", "ccpiu_irs", *cells, "married_NA"]
    write_csv(root / "macro/historical.csv", header, [macro_row(y) for y in range(2013, 2024)])
    # The other file has its columns in another order and one more.
    back = list(reversed(header))
    rows = [list(reversed(macro_row(y))) + [0.05] for y in range(2024, 2056)]
    write_csv(root / "macro/projections.csv", [*back, "rate"], rows)
    quarters = [(f"{y}-Q{q}", "ND" if (y, q) == (2014, 3) else 9e7 + 1e6 * (y - 2012)) for y in range(2012, 2025) for q in range(1, 5)]
    write_csv(root / "b101.csv", ["date", "FL152090005.Q"], quarters)
    for wave in WAVES:
        ids = range(1, 601)
        summary = [
            (i // 5, i, rng.uniform(100, 900), int(rng.integers(18, 95)), int(rng.integers(1, 3)),
             int(rng.integers(0, 3)), round(float(rng.lognormal(10.8, 1)) - 5000, 2))
            for i in ids
        ]
        folder = root / f"scf/{wave}/historical"
        write_csv(folder / f"SCFP{wave}.csv", ["YY1", "Y1", "WGT", "AGE", "MARRIED", "KIDS", "INCOME"], summary)
        columns = [c for names in TRANSFER_COLUMNS.values() for c in names]
        detail = []
        for i in ids:
            entry = []
            for n in (1, 2, 3):
                got = rng.random() < 0.5
                entry += [int(rng.integers(1, 4)), float(round(rng.lognormal(11, 1.5))) if got else 0.0,
                          int(rng.choice(YEARS_REPORTED[wave]))]
            detail.append((i // 5, i, *entry, 1.0))
        types = ", ".join(f"{c} {t}" for c, t in zip(columns, ("int", "double", "int") * 3))
        spark.createDataFrame(detail, f"yy1 long, y1 long, {types}, other double").write.parquet(
            str(folder / f"p{wave % 100:02d}i6.parquet")
        )
    names = ["id", "weight", "age1", "filing_status", "dep_age1", "dep_age2", "dep_age3", *INCOME_ADDED, *INCOME_SUBTRACTED]
    units = [
        (i, round(float(rng.uniform(50, 500)), 3), int(rng.integers(18, 81)), int(rng.integers(1, 5)),
         "NA" if i % 3 else i % 25, "", "", *np.round(rng.lognormal(8, 1, 19), 2), *np.round(rng.lognormal(5, 1, 8), 2))
        for i in range(1500)
    ]
    write_csv(root / "tax_units_2026.csv", names, units)
    return Inputs(
        str(root / "macro"), str(root / "scf"), str(root / "tax_units_2026.csv"), str(root / "b101.csv")
    )


def test_readers(spark, files):
    units = readers.read_tax_units(spark, files.tax_units)
    assert units.count() == 1500
    first = units.where("id = 4").first()
    assert first["dep_age1"] is None and first["dep_age2"] is None and first["weight"] > 0
    macro = readers.read_macro(spark, files.macro_root, files.macro_files)
    assert macro.where("year = 2014").select("gdp", "rate").first() == (pytest.approx(1.04e4), None)
    assert macro.where("year = 2030").first()["rate"] == 0.05
    assert readers.read_net_worth(spark, files.net_worth).where("net_worth = 'ND'").count() == 1
    summary, detail = readers.read_survey(spark, files.survey_root, WAVES)
    assert summary.count() == detail.count() == 2400
    plan = detail.select("y1", "value_1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<y1:bigint,x5804:double>" in plan


def test_run(spark, files, tmp_path):
    settings = Settings(
        sample=20_000, trees=10, depth=8, unit_age_cap=80,
        brackets=(Bracket(5e5, 1e6, 300, 7e5), Bracket(1e6, None, 200, 4e6)),
        exemptions={"baseline": 7.2e5, "obbba": 1.5e6},
    )
    forest = str(tmp_path / "forest")
    final = simulate(
        spark, files, str(tmp_path / "out"), "run1", settings, forest_path=forest, kind="csv"
    )
    rows = final.orderBy("id").select("id", "p_inheritance", "inheritance").collect()
    assert [r["id"] for r in rows] == list(range(1500))
    assert all(r["p_inheritance"] >= 0 and r["inheritance"] > 0 for r in rows)

    written = sinks.read_scenarios(spark, str(tmp_path / "out" / "run1"), "csv")
    counts = written.groupBy("scenario", "year").count().collect()
    assert len(counts) == 60 and {r["count"] for r in counts} == {1500}
    tax = {
        r["scenario"]: r["tax"]
        for r in written.groupBy("scenario").agg(
            F.sum(F.col("estate_tax_liability") * F.col("p_inheritance")).alias("tax")
        ).collect()
    }
    assert tax["baseline"] > tax["obbba"] > 0

    # Of the steps in between nothing is left.
    from pathlib import Path

    from heirflow.sources.shared import shared_folder

    kept = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in kept.iterdir() if p.is_dir()}

    # A second run reuses the stored forest and gives the same result.
    again = simulate(
        spark, files, str(tmp_path / "out"), "run2", settings, estimate=False, forest_path=forest
    )
    assert {p.name for p in kept.iterdir() if p.is_dir()} == before
    other = again.orderBy("id").select("id", "p_inheritance", "inheritance").collect()
    assert [r["inheritance"] for r in other] == pytest.approx([r["inheritance"] for r in rows])
    assert [r["p_inheritance"] for r in other] == pytest.approx([r["p_inheritance"] for r in rows])


def test_repeated_macro_year_is_refused(spark, files, tmp_path):
    from dataclasses import replace

    twice = replace(files, macro_files=("projections.csv", "historical.csv", "historical.csv"))
    with pytest.raises(ValueError, match="rows for"):
        simulate(spark, twice, str(tmp_path), "run", Settings(sample=100))


def test_default_ages(spark, files, tmp_path):
    """Units older than the oldest surveyed ones keep the forest's chance and reach the output."""
    from dataclasses import replace

    raw = spark.read.option("header", True).csv(files.tax_units)
    older = str(tmp_path / "older")
    raw.withColumn("age1", (F.lit(70) + F.col("id") % 23).cast("string")).write.option("header", True).csv(older)
    settings = Settings(
        sample=5_000, trees=3, depth=4, years=(2026, 2027),
        brackets=(Bracket(5e5, 1e6, 300, 7e5), Bracket(1e6, None, 200, 4e6)),
    )
    assert settings.unit_age_cap is None
    final = simulate(spark, replace(files, tax_units=older), str(tmp_path / "out"), "run", settings)
    assert final.where("age = 92").count() > 0
    assert final.where("p_inheritance IS NULL OR inheritance IS NULL").count() == 0
