import numpy as np
import pytest
from plain import running_weight as plain_running
from plain import weighted_quantile
from pyspark.sql import functions as F

from heirflow.operators import ordered
from heirflow.operators.ordered import (
    RANK_LABELS,
    RANK_PROBS,
    cuts_from_percentiles,
    rank_bins,
    running_weight,
    weighted_quantiles,
    weighted_rank,
    weighted_resample,
)

SCHEMA = "id long, g int, x double, w double"


def make_rows(n=900, seed=1, hot=False, fractional=True):
    rng = np.random.default_rng(seed)
    x = rng.lognormal(3, 1, n).round(2)
    if hot:
        x[rng.random(n) < 0.4] = 20.0
    w = rng.uniform(0.2, 5, n) if fractional else rng.integers(1, 9, n).astype(float)
    return [(i, i % 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))]


def test_cuts_give_a_hot_value_its_own_parts():
    cuts = cuts_from_percentiles([1.0, 5.0, 5.0, 5.0, 9.0])
    spot = cuts.limits.index(5.0)
    assert cuts.parts[spot] == 3
    assert cuts.limits[spot + 1] == np.nextafter(5.0, np.inf)
    assert cuts.first_part[spot + 1] - cuts.first_part[spot] == 3


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("buckets", [2, 16, 64])
def test_running_weight(spark, hot, buckets):
    rows = make_rows(hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = running_weight(df, "w", ["id"], "x", buckets)
    expected = plain_running([(i, x, w) for i, _, x, w in rows])
    assert got.total == pytest.approx(sum(r[3] for r in rows))
    assert {r["id"]: r["cum_weight"] for r in got.rows.collect()} == pytest.approx(expected)


def test_hot_value_is_spread(spark):
    """A value with 40% of the rows does not end up in one window partition."""
    df = spark.createDataFrame(make_rows(4000, hot=True), SCHEMA)
    plan_input = running_weight(df, "w", ["id"], "x", 32)
    assert len(plan_input.starts) > 32
    # The bucket starts are the running bucket weights; none of them spans 10% of the total.
    widths = np.diff([*plan_input.starts, plan_input.total])
    assert widths.max() < 0.1 * plan_input.total


def test_missing_weight_or_value_is_refused(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None), (2, 0, 1.0, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="required column w"):
        running_weight(df, "w", ["id"], "x")
    df = spark.createDataFrame([(1, 0, None, 1.0), (2, 0, 1.0, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="required column x"):
        running_weight(df, "w", ["id"], "x")


@pytest.mark.parametrize("hot", [False, True])
def test_rank_does_not_depend_on_partitions(spark, hot):
    rows = make_rows(hot=hot, fractional=False)
    base = spark.createDataFrame(rows, SCHEMA)
    cum = plain_running([(i, x, w) for i, _, x, w in rows])
    total = sum(r[3] for r in rows)
    expected = {i: int(np.floor((2000 * c + total) / (2 * total))) for i, c in cum.items()}
    for df in (base.coalesce(1), base.orderBy(F.desc("w")).repartition(8)):
        got = weighted_rank(df, "x", "w", ["id"])
        assert {r["id"]: r["rank"] for r in got.collect()} == expected


@pytest.mark.parametrize("fractional", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_weighted_quantiles(spark, fractional, hot):
    rows = make_rows(fractional=fractional, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    probs = [0.0, 0.001, 0.25, 0.5, 0.733, 0.99, 1.0]
    got = weighted_quantiles(df, "x", "w", probs).orderBy("prob_index").collect()
    expected = weighted_quantile([r[2] for r in rows], [r[3] for r in rows], probs)
    assert [r["quantile"] for r in got] == pytest.approx(expected)


def test_weighted_quantiles_by_group(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    probs = [i / 20 for i in range(21)]
    got = weighted_quantiles(df, "x", "w", probs, by=["g"], buckets=8).collect()
    for g in range(3):
        mine = [r["quantile"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["prob_index"])]
        part = [r for r in rows if r[1] == g]
        assert mine == pytest.approx(
            weighted_quantile([r[2] for r in part], [r[3] for r in part], probs)
        )


def test_integer_weights_agree_with_percentile(spark):
    df = spark.createDataFrame(make_rows(fractional=False), SCHEMA)
    probs = [i / 100 for i in range(101)]
    expected = df.agg(F.percentile("x", probs, F.col("w").cast("int"))).first()[0]
    got = weighted_quantiles(df, "x", "w", probs).orderBy("prob_index").collect()
    assert [r["quantile"] for r in got] == pytest.approx(expected)


def test_one_row_holds_most_weight(spark):
    rows = [(i, 0, float(i), 1.0) for i in range(50)] + [(50, 0, 25.5, 5000.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = weighted_quantiles(df, "x", "w", [0.3, 0.5, 0.9]).collect()
    assert {r["quantile"] for r in got} == {25.5}


def test_bins_edges(spark):
    """Labels, the two outside rules, and the null."""
    rows = [(i, 0, float(i * 100), 1.0) for i in range(1, 2001)]
    extra = [(3000, 0, -5.0, 1.0), (3001, 0, 50.0, 1.0), (3002, 0, 1e9, 1.0), (3003, 0, None, 1.0)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = {
        r["id"]: r["income_pctile"]
        for r in rank_bins(df, "x", "w", seed=1, floor=60.0).collect()
    }
    assert got[3000] == 0.0  # below the floor
    assert got[3001] == 0.0  # positive, at or under the lowest break, below the floor
    assert got[3002] == 1.0
    assert got[3003] is None
    assert set(got.values()) - {None, 0.0} == set(RANK_LABELS)
    inside = [got[i] for i in range(3, 2001)]
    assert inside == sorted(inside)
    assert rank_bins(df, "x", "w", seed=1, floor=40.0).where("id = 3001").first()["income_pctile"] == 1.0
    assert len(RANK_PROBS) == 105 and len(RANK_LABELS) == 104


def test_bins_survive_collapsed_breaks(spark):
    """With one repeated income all breaks fall within one unit of it."""
    df = spark.createDataFrame([(i, 0, 100.0, 1.0) for i in range(40)], SCHEMA)
    labels = {r["income_pctile"] for r in rank_bins(df, "x", "w", 1, 10.0).collect()}
    assert labels == {1.0}


@pytest.mark.parametrize("buckets", [2, 40])
def test_resample(spark, buckets):
    rows = make_rows() + [(9000, 0, 1.0, 0.0), (9001, 0, 1.0, 900.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = 3000
    got = weighted_resample(df, "w", ["id"], n, seed=5, buckets=buckets).collect()
    total = sum(r[3] for r in rows)
    assert sorted(r["draw_id"] for r in got) == list(range(n))
    assert sum(r["w"] for r in got) == pytest.approx(total)
    hits = [r["id"] for r in got]
    assert 9000 not in hits
    assert hits.count(9001) / n == pytest.approx(900 / total, abs=0.03)


def test_resample_picks_the_row_whose_interval_holds_the_draw(spark):
    from plain import uniform

    rows = make_rows(300, fractional=False, hot=True)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["draw_id"]: r["id"] for r in weighted_resample(df, "w", ["id"], 500, seed=5).collect()}
    order = sorted(rows, key=lambda r: (uniform(r[0], 0, "tie"), r[0]))
    ends = np.cumsum([r[3] for r in order])
    for k in range(500):
        at = uniform(k, 5, "resample") * ends[-1]
        assert got[k] == order[int(np.searchsorted(ends, at, side="right"))][0]


WIDE = "a int, k string, w double, note string, x double"


def wide_rows(n=3000):
    return [(i % 7 if i % 50 else None, f"k{i}", 1.0 + i % 5 + i / 7, None if i % 3 else f"n{i}", float(i)) for i in range(n)]


def test_large_resample_agrees_with_the_joined_one_without_a_join(spark, monkeypatch):
    """More draws than may be sent: rows are taken along, in one shuffle, and the draws are those of the join."""
    df = spark.createDataFrame(wide_rows(), WIDE).repartition(5)
    joined = weighted_resample(df, "w", ["a", "k"], 4000, seed=5)
    monkeypatch.setattr(ordered._draw_in_buckets, "__defaults__", (300,))
    taken = weighted_resample(df, "w", ["a", "k"], 4000, seed=5, most_sent=100)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert taken.schema.simpleString() == joined.schema.simpleString()
    rest = [c for c in joined.columns if c != "w"]
    assert sorted(map(str, taken.select(rest).collect())) == sorted(map(str, joined.select(rest).collect()))
    assert taken.select("w").distinct().collect()[0]["w"] == pytest.approx(joined.first()["w"])


def test_resample_takes_along_only_what_is_read_later(spark, monkeypatch):
    df = spark.createDataFrame(wide_rows(), WIDE).repartition(5)
    monkeypatch.setattr(ordered._draw_in_buckets, "__defaults__", (300,))
    rest = ["x", "note"]
    for most_sent in (100, 10_000):
        draw = lambda **given: weighted_resample(df, "w", ["a", "k"], 4000, seed=5, most_sent=most_sent, **given)
        whole, some = draw(), draw(columns=[*rest, "w"])
        assert some.columns == [*rest, "w"]
        assert sorted(map(str, some.select(rest).collect())) == sorted(map(str, whole.select(rest).collect()))
        assert some.select("w").distinct().collect() == whole.select("w").distinct().collect()
        assert draw(columns=["w"]).count() == 4000
    # neither the number of the draw nor another column is shuffled
    plan = weighted_resample(df, "w", ["k"], 4000, 5, most_sent=100, columns=["x"])._jdf.queryExecution().executedPlan().toString()
    moved = "".join(line for line in plan.splitlines() if "Project" in line)
    assert "_at" in moved and "note" not in moved and "draw_id" not in moved


def test_large_resample_with_one_heavy_row(spark):
    """The bucket of a row that is hit by half of all draws isn't put in one task."""
    df = spark.createDataFrame([*wide_rows(), (1, "heavy", 400_000.0, None, 0.5)], WIDE)
    heavy = ordered._draw_in_buckets(df, "w", ["k"], 20_000, 5, "draw_id", 200)
    assert heavy is None
    few = weighted_resample(df, "w", ["k"], 5000, seed=5, most_sent=100)
    assert sorted(r["draw_id"] for r in few.collect()) == list(range(5000))


def test_resample_refuses_repeated_keys_and_missing_weights(spark):
    rows = [*wide_rows(500), (3, "k3", 2.0, None, 0.0)]
    for most_sent in (10, 10_000):
        with pytest.raises(Exception, match="the table to draw from has"):
            weighted_resample(spark.createDataFrame(rows, WIDE), "w", ["k"], 600, 5, most_sent=most_sent).collect()
        with pytest.raises(Exception, match="null in required column w"):
            missing = [*wide_rows(50), (3, "z", None, None, 0.0)]
            weighted_resample(spark.createDataFrame(missing, WIDE), "w", ["k"], 600, 5, most_sent=most_sent).collect()


def test_quantiles_at_the_edges_of_buckets(spark):
    """Every probability is found by the bucket that holds its position, in any order of the probabilities."""
    rows = make_rows(900)
    df = spark.createDataFrame(rows, SCHEMA)
    probs = [i / 500 for i in range(501)]
    values, weights = [r[2] for r in rows], [r[3] for r in rows]
    for buckets in (3, 200):
        for asked in (probs, probs[::-1]):
            got = {r["prob_index"]: r["quantile"] for r in weighted_quantiles(df, "x", "w", asked, buckets=buckets).collect()}
            assert [got[i] for i in range(501)] == pytest.approx(weighted_quantile(values, weights, asked))
    one = spark.createDataFrame([(1, 0, 7.0, 0.5)], SCHEMA)
    assert {r["quantile"] for r in weighted_quantiles(one, "x", "w", probs).collect()} == {7.0}


def test_plans_stay_partitioned(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    for result in (
        weighted_rank(df, "x", "w", ["id"]),
        weighted_resample(df, "w", ["id"], 100, seed=5),
        weighted_quantiles(df, "x", "w", [0.1, 0.5]),
        rank_bins(df, "x", "w", 1, 10.0, by=["g"]),
    ):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_values_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, float("nan"), 1.0)], "id long, v double, w double")
    with pytest.raises(ValueError, match="NaN"):
        weighted_rank(df, "v", "w", ["id"])
