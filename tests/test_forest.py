"""Forests on counted cells, against plain trees on rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heirflow.operators import forest

FEATURES = ["a", "b"]


def plain_tree(rows, target, depth, least, cuts):
    """Nested tuples of the tree on all rows: (feature, cut, low, high), or the row numbers of a leaf."""

    def grow(members, level):
        y = target[members]
        best = (1e-15, None, None)
        if level < depth:
            for f in range(rows.shape[1]):
                for cut in cuts[f]:
                    low = rows[members, f] <= cut
                    n, m = low.sum(), (~low).sum()
                    if n >= least and m >= least:
                        gain = round(y.var() - (n * y[low].var() + m * y[~low].var()) / len(y), 12)
                        if gain > best[0] + 1e-11:
                            best = (gain, f, cut)
        if best[1] is None:
            return members
        low = rows[members, best[1]] <= best[2]
        return best[1], best[2], grow(members[low], level + 1), grow(members[~low], level + 1)

    return grow(np.arange(len(rows)), 0)


def leaf_of(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 12, 900), r.integers(0, 5, 900) / 10])
    amount = np.round(np.exp(r.normal(x[:, 0] / 4, 1 + x[:, 1])), 2)
    hit = (r.random(900) < x[:, 0] / 15 + x[:, 1]).astype(float)
    rows = [(i, int(a), float(b), float(v), float(h)) for i, ((a, b), v, h) in enumerate(zip(x, amount, hit))]
    return x, amount, hit, spark.createDataFrame(rows, "id long, a int, b double, amount double, hit double").repartition(3)


def cuts_of(x):
    return [(np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2 for f in range(x.shape[1])]


@pytest.mark.parametrize("target", ["hit", "amount"])
def test_one_tree_is_that_of_the_rows(spark, data, target):
    x, amount, hit, df = data
    y = hit if target == "hit" else amount
    model = forest.fit_forest(df, 1, target, FEATURES, trees=1, depth=4, min_leaf=30, bootstrap=False)
    tree = plain_tree(x, y, 4, 30, cuts_of(x))
    extra = spark.createDataFrame([(1_000, -5, 0.0, 0.0, 0.0), (1_001, 99, 0.17, 0.0, 0.0)], df.schema)
    for r in forest.forest_mean(df.union(extra), model, "p").collect():
        assert r.p == pytest.approx(y[leaf_of(tree, (r.a, r.b))].mean(), abs=1e-12)


def test_distribution_of_a_leaf(data):
    x, amount, hit, df = data
    model = forest.fit_forest(df, 1, "hit", FEATURES, trees=1, depth=3, min_leaf=40, bootstrap=False)
    tree = plain_tree(x, hit, 3, 40, cuts_of(x))
    probs, bound = (0.05, 0.5, 0.9, 1.0), 4.0
    found = forest.forest_distribution(df, model, df, "hit", "amount", probs, [bound]).collect()
    assert len(found) == len(x)
    for r in found:
        values = np.sort(amount[leaf_of(tree, (r.a, r.b))])
        assert r["mean"] == pytest.approx(values.mean())
        assert [r[f"q{i}"] for i in range(4)] == [values[math.ceil(p * len(values) - 1e-9) - 1] for p in probs]
        assert r.above0 == pytest.approx((values > bound).mean())


def test_bootstrapped_distribution_agrees_with_the_mean(data, tmp_path):
    *_, df = data
    model = forest.fit_forest(df, 7, "hit", FEATURES, trees=12, depth=6, min_leaf=20)
    both = forest.forest_distribution(forest.forest_mean(df, model), model, df, "hit", "hit", [0.5], [0.5]).collect()
    assert all(r["mean"] == pytest.approx(r.p_inheritance) and r.above0 == pytest.approx(r.p_inheritance) for r in both)
    assert all(r.q0 == (1.0 if r.p_inheritance > 0.5 else 0.0) for r in both if abs(r.p_inheritance - 0.5) > 1e-9)
    # trees differ, and don't depend on partitions
    again = forest.fit_forest(df.repartition(7, "b"), 7, "hit", FEATURES, trees=12, depth=6, min_leaf=20)
    rows = lambda m: sorted(map(tuple, m.nodes.collect()), key=str)
    assert rows(model) == rows(again)
    roots = [r["weight"] for r in model.nodes.where("node = 1").collect()]
    assert len(roots) == 12 and len(set(roots)) > 6 and abs(np.mean(roots) - 900) < 40
    forest.save_forest(model, str(tmp_path / "f"))
    assert rows(forest.load_forest(df.sparkSession, str(tmp_path / "f"))) == rows(model)


@pytest.mark.parametrize("count", [1, 3, 16, 17, 400])
def test_poisson(spark, count):
    drawn = forest.with_poisson(spark.range(20_000).withColumn("n", F.lit(count)), "n", ["id"], 2, "w").select("w")
    mean, variance, third = drawn.agg(F.avg("w"), F.variance("w"), F.skewness("w")).first()
    assert abs(mean - count) < 5 * math.sqrt(count / 20_000)
    assert variance == pytest.approx(count, rel=0.06) and third == pytest.approx(1 / math.sqrt(count), abs=0.08)
    zero = drawn.where("w = 0").count() / 20_000
    assert zero == pytest.approx(math.exp(-count), abs=0.015)


def test_refusals(spark, data):
    *_, df = data
    with pytest.raises(ValueError, match="bin them"):
        forest.fit_forest(df, 1, "hit", FEATURES, trees=2, max_cells=10)
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_forest(df.limit(0), 1, "hit", FEATURES, trees=2)
    with pytest.raises(Exception, match="hit"):
        forest.fit_forest(df.withColumn("hit", F.when(F.col("id") > 3, F.col("hit"))), 1, "hit", FEATURES, trees=2)
