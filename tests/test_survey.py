import pytest
from pyspark.sql import functions as F

from heirflow.operators import macro, survey
from heirflow.operators.reshape import demographic_long, duplicate, events_long, events_wide
from heirflow.sources.readers import union_by_name

KEY = list(survey.SURVEY_KEY)
WIDE = (
    "survey_year int, yy1 long, y1 long, weight double, type_1 int, value_1 double, year_1 int, "
    "type_2 int, value_2 double, year_2 int, type_3 int, value_3 double, year_3 int"
)


@pytest.fixture(scope="module")
def waves(spark):
    years = {2013: 2010, 2016: 2015, 2019: 2019, 2022: 2020}
    rows = [
        (w, y1 // 5, y1, 10.0, 1 + y1 % 3, 100.0 + y1, y, 2, 50.0, w, 1, None if y1 % 2 else 400.0, y)
        for w, y in years.items()
        for y1 in range(60)
    ]
    return spark.createDataFrame(rows, WIDE)


def test_copies_keep_the_weight(waves):
    out = duplicate(waves, 5)
    assert out.count() == 5 * waves.count()
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(waves.agg(F.sum("weight")).first()[0])
    assert sorted(r[0] for r in out.select("dup_id").distinct().collect()) == [1, 2, 3, 4, 5]


def test_timing(spark):
    pairs = [(2022, 2022), (2022, 2020), (2022, 2021), (2013, 2010), (2019, None)]
    df = spark.createDataFrame(pairs, "w int, y int")
    got = df.select(survey.timing_probability(F.col("w"), F.col("y"))).collect()
    assert [r[0] for r in got] == [1.0, 0.28, 0.0, 0.1, 0.0]


def test_realise_agrees_with_the_long_way(waves):
    """Events to rows, filter, back to columns, thin, take the largest."""
    copies = duplicate(waves, 5)
    direct = survey.realise(copies, seed=1)
    events = survey.possible_inheritances(events_long(copies, KEY))
    wide = events_wide(events, KEY)
    names = [c for c in wide.columns if c not in KEY]
    thin = survey.uniform
    wide = wide.fillna(0.0, names)
    largest = F.greatest(*[
        F.when(thin(*[F.col(k) for k in KEY], seed=1, draw=f"event{n}") < F.col(f"p_{n}"), F.col(f"value_{n}"))
        .otherwise(F.lit(0.0))
        for n in (1, 2, 3)
    ])
    expected = {tuple(r[k] for k in KEY): r["x"] for r in wide.withColumn("x", largest).collect()}
    got = {
        tuple(r[k] for k in KEY): r["inheritance"]
        for r in direct.where("inheritance is not null").collect()
    }
    assert got == expected
    assert 0.0 in got.values() and max(got.values()) > 0


def test_thinning_rate(spark):
    rows = [(2022, 0, i, 1.0, 1, 5.0, 2020, None, None, None, None, None, None) for i in range(5000)]
    df = survey.with_inheritance(duplicate(spark.createDataFrame(rows, WIDE), 2), seed=4)
    assert df.agg(F.avg("has_inheritance")).first()[0] == pytest.approx(0.28, abs=0.015)


def test_gifts_and_zero_values_do_not_count(spark):
    rows = [
        (2022, 0, 1, 1.0, 3, 5.0, 2022, None, None, None, None, None, None),
        (2022, 0, 2, 1.0, 1, 0.0, 2022, 1, -1.0, 2022, None, None, None),
    ]
    df = survey.with_inheritance(duplicate(spark.createDataFrame(rows, WIDE), 1), seed=4)
    assert {(r["inheritance"], r["has_inheritance"]) for r in df.collect()} == {(0.0, 0)}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        (y, 10.0 * (y - 2012), float(y - 2000), 100.0 + y, 50.0 * (y - 2012), 20.0, 3.0)
        for y in range(2013, 2031)
    ]
    return spark.createDataFrame(
        rows, "year int, gdp double, cpiu double, ccpiu_irs double, married_40 double, unmarried_40 double, married_NA double"
    )


def test_demographic_long(cells):
    got = demographic_long(cells.where("year = 2014")).collect()
    assert {tuple(r) for r in got} == {(2014, 1, 40, 100.0), (2014, 0, 40, 20.0)}


def test_missing_cells_stay(spark):
    wide = spark.createDataFrame([(2014, None, 2.0)], "year int, married_1 double, unmarried_1 double")
    got = {tuple(r) for r in demographic_long(wide).collect()}
    assert got == {(2014, 1, 1, None), (2014, 0, 1, 2.0)}
    assert macro.population_by_year(demographic_long(wide)).first()["population"] == 2.0


def test_population_without_values_is_zero(spark):
    cells = spark.createDataFrame([(2014, 1, 1, None)], "year int, married int, age int, population double")
    assert macro.population_by_year(cells).first()["population"] == 0.0


def test_aging(spark, cells):
    demographic = demographic_long(cells)
    rows = spark.createDataFrame(
        [(2014, 1, 40, 2.0), (2014, 0, 40, 2.0), (2014, 1, 41, 2.0)],
        "survey_year int, married int, age int, weight double",
    )
    got = {(r["married"], r["age"]): r["weight"] for r in survey.age_weights(rows, demographic, 2026).collect()}
    assert got == {(1, 40): 2.0 * 700 / 100, (0, 40): 2.0, (1, 41): None}


def test_net_worth_per_capita(spark, cells):
    quarters = [(f"{y}-Q{q}", str(100.0 * (y - 2012) + q)) for y in range(2010, 2025) for q in (1, 3)]
    quarters = [(d, "ND" if d == "2015-Q3" else v) for d, v in quarters]
    series = macro.net_worth_per_capita(
        spark.createDataFrame(quarters, "date string, net_worth string"),
        macro.economic(cells),
        demographic_long(cells),
    )
    got = {r["year"]: r["net_worth_pc"] for r in series.collect()}
    assert sorted(got) == list(range(2013, 2027))
    assert got[2015] is None
    assert got[2014] == pytest.approx(203.0 * 1e6 / 120)
    assert got[2026] == pytest.approx(1103.0 * 140 / 110 * 1e6 / 720)


def test_anchor_year_must_be_there_once(spark, cells):
    with pytest.raises(ValueError, match="exactly one row for year 2050"):
        macro.projection_indexes(macro.economic(cells), demographic_long(cells), 2026, 2030, 2050)
    twice = union_by_name([cells, cells.where("year = 2026")])
    with pytest.raises(ValueError, match="rows for one value of"):
        survey.demographic_factor(demographic_long(twice), 2026)


def test_indexes_are_one_at_the_anchor(cells):
    got = {
        r["year"]: r
        for r in macro.projection_indexes(macro.economic(cells), demographic_long(cells), 2026, 2030, 2026).collect()
    }
    assert sorted(got) == list(range(2026, 2031))
    assert got[2026]["inflation_index"] == 1.0 and got[2026]["gdp_pc_index"] == 1.0
    assert got[2030]["inflation_index"] == pytest.approx(2130 / 2126)


def test_age_cap(spark):
    df = spark.createDataFrame([(79,), (80,), (95,), (None,)], "age int")
    assert [r[0] for r in survey.cap_age(df, 80).collect()] == [79, 80, 80, None]
    assert survey.cap_age(df, None) is df


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "year int, x double")
    b = spark.createDataFrame([(3.0, 4)], "y double, year int")
    got = union_by_name([a, b])
    assert got.columns == ["year", "x", "y"]
    assert {tuple(r) for r in got.collect()} == {(1, 2.0, None), (4, None, 3.0)}


def test_repeated_macro_years_are_refused(spark):
    from heirflow.operators import macro

    economic = spark.createDataFrame([(y, 1.0 * y, 1.0, 100.0) for y in (2029, 2030, 2030)], "year int, gdp double, cpiu double, ccpiu_irs double")
    people = [(y, m, 40, 10.0) for y in (2029, 2030) for m in (0, 1)]
    demographic = spark.createDataFrame(people, "year int, married int, age int, population double")
    with pytest.raises(ValueError, match="2030"):
        macro.projection_indexes(economic, demographic, 2029, 2030, 2029)
    with pytest.raises(ValueError, match="year 2029"):
        macro.projection_indexes(economic.distinct(), demographic.union(demographic.where("year = 2029")), 2029, 2030, 2029)


def test_lookups_match_null_keys_and_large_ones_shuffle(spark):
    from heirflow.operators.lookup import lookup_join

    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    right = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double")
    for most in (100, 1):
        rows = {r["id"]: r["v"] for r in lookup_join(left, right, ["k"], most).collect()}
        assert rows == {1: 1.0, 2: 2.0, 3: None}
        with pytest.raises(ValueError):
            lookup_join(left, right.union(right), ["k"], most)


def test_published_constants():
    """Stated here once more, so that a slip in the package can't hide behind its own twin."""
    from heirflow.operators import ordered, projection, survey
    from heirflow.sources import schemas

    assert ordered.RANK_PROBS == [k / 100 for k in range(100)] + [0.991, 0.993, 0.995, 0.997, 0.999]
    assert ordered.RANK_LABELS == [k / 100 for k in range(1, 100)] + [0.992, 0.994, 0.996, 0.998, 1.0]
    assert set(survey.TIMING) == {
        (2013, 2010, 0.1), (2013, 2013, 1.0), (2016, 2015, 0.36), (2019, 2019, 0.82), (2022, 2020, 0.28), (2022, 2022, 1.0),
    }
    assert projection.BASELINE == {"baseline": 7.2e6}
    assert projection.REFORMS == {"tcja": 14.3e6, "obbba": 15e6, "tcja_ext": 14e6}
    assert len(schemas.INCOME_ADDED) == 19 and len(schemas.INCOME_SUBTRACTED) == 8
