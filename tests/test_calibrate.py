import numpy as np
import pytest
from plain import calibrate as plain_calibrate
from pyspark.sql import functions as F

from heirflow.operators.calibrate import (
    BracketMap,
    ESTATE_BRACKETS,
    Bracket,
    Promotion,
    age_group,
    bracket_summary,
    calibrate_brackets,
    match_quantiles,
    per_heir,
    promote,
    quantile_factors,
    rake,
    rake_targets,
)

SCHEMA = "id long, weight double, p_inheritance double, inheritance double"


def draw(n=600, seed=3):
    rng = np.random.default_rng(seed)
    return [
        (i, float(w), float(p), float(v))
        for i, (w, p, v) in enumerate(
            zip(rng.integers(1, 8, n), rng.uniform(0.02, 0.2, n), rng.lognormal(12.5, 1.3, n).round(2))
        )
    ]


def check_against_plain(spark, rows, brackets, heirs=2.8, rule=Promotion()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = calibrate_brackets(df, 8, brackets, heirs, rule=rule)
    got = {r["id"]: (r["p_inheritance"], r["inheritance"]) for r in got.collect()}
    targets = [(b.low, b.high, b.count, b.average) for b in per_heir(brackets, heirs)]
    expected = plain_calibrate(rows, targets, heirs, 8, rule.most, rule.percentile, rule.alpha)
    assert got.keys() == expected.keys()
    for i in expected:
        assert got[i] == pytest.approx(expected[i]), i
    return got


def test_brackets_match_the_plain_steps(spark):
    """Cap, scaling and promotion all happen here."""
    brackets = (
        Bracket(5e5, 1e6, 150, 0.9e6),
        Bracket(1e6, 2e6, 300, 1.6e6),
        Bracket(2e6, 5e6, 20, 3e6),
        Bracket(5e6, None, 10, 17.5e6),
    )
    check_against_plain(spark, draw(), brackets)
    check_against_plain(spark, draw(), brackets, rule=Promotion(most=7, percentile=0.8))


def test_tied_values_are_promoted_by_id(spark):
    rows = [(i, 1.0, 0.1, 1000.0) for i in range(300)] + [(999, 1.0, 0.1, 6000.0)]
    got = check_against_plain(spark, rows, (Bracket(14000.0, None, 50, 28000.0),), rule=Promotion(most=10))
    assert [i for i in range(300) if got[i][1] != 1000.0] == list(range(10))


def test_empty_bracket_is_skipped(spark):
    """No row inside: nothing is scaled and nothing is promoted."""
    rows = draw(50)
    brackets = (Bracket(1e12, None, 100, 2e12),)
    got = check_against_plain(spark, rows, brackets)
    assert all(got[i][1] == v for i, _, _, v in rows)


def test_rounding_residue_promotes_nothing(spark):
    rows = [(i, 3.0, 0.1, 1000.0 + i) for i in range(100)] + [(500, 7.0, 0.03, 9000.0)]
    got = check_against_plain(spark, rows, (Bracket(22400.0, None, 0.29, 22400.0),))
    assert all(got[i][1] == 1000.0 + i for i in range(100))


def test_sure_rows_still_get_new_values(spark):
    """Candidates at p = 1 have no headroom, yet their values change."""
    rows = [(i, 1.0, 1.0, 1000.0 + i) for i in range(100)] + [(500, 1.0, 0.5, 9000.0)]
    got = check_against_plain(spark, rows, (Bracket(22400.0, None, 40.0, 22400.0),))
    assert got[99][0] == 1.0 and got[99][1] >= 8000.0


def test_percentile_rule_is_exact(spark):
    rows = draw(401)
    df = spark.createDataFrame(rows, SCHEMA)
    v = np.array([r[3] for r in rows])
    for percentile in (0.5, 0.75, 0.951):
        low = float(np.quantile(v, 0.97))
        got = promote(df, Bracket(low, None, 1, 1e9), 5.0, 8, "x", Promotion(1000, percentile))
        changed = {r["id"] for r in got.where("inheritance >= 1e9").collect()}
        assert changed == {i for i, x in enumerate(v) if x < low and x >= np.quantile(v, percentile)}


def test_count_target_is_met_when_the_cap_allows(spark):
    rows = draw()
    b = Bracket(5e5, 1e6, 20, 0.1e6)
    out = calibrate_brackets(spark.createDataFrame(rows, SCHEMA), 8, [b], 2.8, shrink=1.0)
    low, high = b.low / 2.8, b.high / 2.8
    inside = out.where((F.col("inheritance") >= low) & (F.col("inheritance") < high))
    count = inside.agg(F.sum(F.col("p_inheritance") * F.col("weight"))).first()[0]
    before = sum(w * p for _, w, p, v in rows if low <= v < high)
    assert count == pytest.approx(max(before, 20 * 2.8))


def test_published_brackets():
    heirs = per_heir(ESTATE_BRACKETS, 2.8)
    assert [round(b.count) for b in heirs] == [8960, 4480, 3360, 1400]
    assert heirs[-1].high is None and heirs[0].average == 7.5e6 / 2.8


RAKE = "id long, age int, married int, weight double, p_inheritance double"


def test_rake_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [
        (i, int(a), int(m), float(w), float(p))
        for i, (a, m, w, p) in enumerate(
            zip(rng.integers(18, 93, 500), rng.integers(0, 2, 500), rng.uniform(1, 5, 500), rng.uniform(0.1, 0.9, 500))
        )
    ]
    df = spark.createDataFrame(rows, RAKE)
    train = spark.createDataFrame(
        [(int(a), int(m), float(w), float(v)) for a, m, w, v in zip(
            rng.integers(18, 81, 400), rng.integers(0, 2, 400), rng.uniform(1, 5, 400), rng.integers(0, 2, 400))],
        "age int, married int, weight double, inheritance double",
    )
    targets = rake_targets(train, 4)
    out = rake(df, targets)
    sums = {
        (r[0], r[1]): r[2]
        for r in out.groupBy("married", "age_group").agg(F.sum(F.col("p_inheritance") * F.col("weight"))).collect()
    }
    wanted = {(r["married"], r["age_group"]): r["actual"] for r in targets.collect()}
    for cell, total in sums.items():
        if cell in wanted:
            assert total == pytest.approx(wanted[cell])
        else:
            assert cell[1] >= 85 and total is None  # no survey record that old
    capped = rake(df, targets.withColumn("actual", F.lit(1e6)), cap=1.0)
    assert capped.agg(F.max("p_inheritance")).first()[0] == 1.0
    assert rake(df, targets.withColumn("actual", F.lit(1e6))).agg(F.max("p_inheritance")).first()[0] > 1.0


def test_repeated_targets_are_refused(spark):
    df = spark.createDataFrame([(1, 30, 1, 1.0, 0.5)], RAKE)
    targets = spark.createDataFrame([(1, 30, 1.0), (1, 30, 2.0)], "married int, age_group int, actual double")
    with pytest.raises(ValueError, match="lookup has 2 rows"):
        rake(df, targets)


def test_age_group(spark):
    df = spark.createDataFrame([(a,) for a in (0, 4, 5, 79, 80)], "age int")
    assert [r[0] for r in df.select(age_group()).collect()] == [0, 0, 5, 75, 80]


def test_equal_distributions_need_no_change(spark):
    df = spark.createDataFrame(draw(400), SCHEMA)
    factors = quantile_factors(df, df, "weight", "weight", steps=100)
    assert factors.count() == 101
    assert factors.agg(F.min("factor"), F.max("factor")).first() == (1.0, 1.0)
    out = {r["id"]: r["inheritance"] for r in match_quantiles(df, factors, steps=100).collect()}
    assert out == {r["id"]: r["inheritance"] for r in df.collect()}


def test_matching_moves_the_distribution(spark):
    actual = spark.createDataFrame([(i, 1.0, 1.0, 10.0 + i) for i in range(1001)], SCHEMA)
    predicted = spark.createDataFrame([(i, 1.0, 1.0, 20.0 + 2 * i) for i in range(1001)], SCHEMA)
    factors = quantile_factors(actual, predicted, "weight", "weight")
    out = match_quantiles(predicted, factors)
    assert out.agg(F.avg("inheritance")).first()[0] == pytest.approx(510.0, rel=1e-3)


def test_summary_by_bracket(spark):
    rows = [(1, 2.0, 0.5, 1e6), (2, 4.0, 0.25, 3e6), (3, 1.0, 1.0, 1e8), (4, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        r["gross_estate_group"]: r
        for r in bracket_summary(df, {"current_law": 7.2e6, "reform": 15e6}).collect()
    }
    assert set(got) == {1, 2, 5, None}
    assert got[1]["amount_current_law"] == 0 and got[1]["n_inheritances"] == 1.0
    tax = (3e6 * 2.8 - 7.2e6) * 0.4 / 2.8
    assert got[2]["amount_current_law"] == pytest.approx(tax / 1e9)
    assert got[2]["count_heirs_reform"] == 0.0
    assert got[5]["count_estates_reform"] == pytest.approx(1 / 2.8)
    assert got[None]["inheritances"] is None


def test_promotion_leaves_missing_amounts_out(spark):
    """Rows without an amount change nothing: not the percentile, not the choice."""
    rows = [(i, 1.0, 0.1, float(i)) for i in range(1, 101)]
    bracket = Bracket(200.0, None, 10, 300.0)
    for more in ([], [(1000 + i, 1.0, 0.1, None) for i in range(200)]):
        df = spark.createDataFrame(rows + more, SCHEMA)
        done = promote(df, bracket, 2.0, 8, "x", Promotion(most=50)).collect()
        assert sorted(r["id"] for r in done if r["inheritance"] is not None and r["inheritance"] > 200) == list(range(96, 101))
        assert sum(r["inheritance"] is None for r in done) == len(more)


def test_promotion_refuses_repeated_ids(spark):
    rows = [(1, 1.0, 0.1, 5.0), (2, 1.0, 0.1, 90.0), (2, 1.0, 0.1, 3.0), (3, 1.0, 0.1, 1.0)]
    with pytest.raises(ValueError, match="repeated"):
        promote(spark.createDataFrame(rows, SCHEMA), Bracket(100.0, None, 1, 200.0), 1.0, 8, "x", Promotion(percentile=0.5))


def test_cells_without_a_target(spark):
    df = spark.createDataFrame([(1, 40, 1, 2.0, 0.5), (2, 90, 1, 1.0, 0.25)], "id long, age int, married int, weight double, p_inheritance double")
    targets = spark.createDataFrame([(1, 40, 2.0)], "married int, age_group int, actual double")
    p = lambda **how: {r["id"]: r["p_inheritance"] for r in rake(df, targets, **how).collect()}
    assert p() == {1: 1.0, 2: None} and p(missing_target="keep") == {1: 1.0, 2: 0.25}
    with pytest.raises(Exception, match="target of a cell"):
        p(missing_target="error")
    with pytest.raises(ValueError):
        p(missing_target="drop")


def test_plan_of_a_bracket_does_not_grow(spark):
    """The map of many brackets is applied in one step, and gives what the steps one after the other gave."""
    done = BracketMap()
    r = np.random.default_rng(2)
    v = np.exp(r.normal(3, 2, 2_000))
    x, p = v.copy(), np.full(2_000, 0.3)
    for low in (1.0, 5.0, 30.0, 200.0, 1_000.0):
        high, chance, factor = low * 6, 1 + r.random(), 1 + 3 * r.random()
        inside = (x >= low) & (x < high)
        done.scale(Bracket(low, high, 0, 0), chance, factor)
        x, p = np.where(inside, x * factor, x), np.where(inside, np.minimum(1, p * chance), p)
    df = spark.createDataFrame([(i, float(a), 0.3) for i, a in enumerate(v)] + [(5_000, None, 0.3)], "id long, inheritance double, p_inheritance double")
    mapped = done.on(df, "id", "inheritance", "p_inheritance")
    found = {r.id: (r.inheritance, r.p_inheritance) for r in mapped.collect()}
    assert found.pop(5_000) == (None, 0.3)
    got = np.array([found[i] for i in range(2_000)])
    assert np.allclose(got[:, 0], x, rtol=1e-12) and np.allclose(got[:, 1], p, rtol=1e-12)
    depth = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert depth(mapped) <= depth(BracketMap([-np.inf, 2.0], [1.0, 2.0], [1.0, 1.0]).on(df, "id", "inheritance", "p_inheritance")) + 4
