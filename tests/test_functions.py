import numpy as np
from plain import uniform as plain_uniform
from pyspark.sql import functions as F
import pytest

from heirflow.functions import (
    count_below,
    greatest_or_null,
    least_or_null,
    normal,
    pareto,
    required,
    uniform,
)


def test_missing_stays_missing(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        greatest_or_null(a, b).alias("most"),
        least_or_null(a, b).alias("least"),
    ).collect()
    assert [tuple(r) for r in rows] == [(None, None), (2.0, 1.0)]


def test_required_refuses_null(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "w double")
    with pytest.raises(Exception, match="null in required column w"):
        df.agg(F.sum(required(F.col("w"), "w"))).collect()


def test_uniform_is_keyed_and_ignores_partitions(spark):
    df = spark.range(2000)
    u = uniform(F.col("id"), seed=8, draw="z")
    one = {r[0]: r[1] for r in df.coalesce(1).select("id", u).collect()}
    many = {r[0]: r[1] for r in df.repartition(7).select("id", u).collect()}
    assert one == many
    assert one[17] == plain_uniform(17, 8, "z")
    assert 0 <= min(one.values()) and max(one.values()) < 1
    assert abs(np.mean(list(one.values())) - 0.5) < 0.02


def test_normal_and_pareto_moments(spark):
    row = (
        spark.range(20000)
        .select(
            normal(F.col("id"), seed=1, draw="z").alias("z"),
            pareto(10.0, 3.0, F.col("id"), seed=1, draw="x").alias("x"),
        )
        .agg(F.avg("z"), F.stddev("z"), F.min("x"), F.avg("x"))
        .first()
    )
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03
    assert row[2] >= 10 and abs(row[3] - 15) < 0.5


@pytest.mark.parametrize("size", [0, 1, 2, 7, 8, 105])
def test_count_below(spark, size):
    breaks = np.sort(np.random.default_rng(size).uniform(0, 10, size))
    values = [-1.0, 0.0, 5.0, 11.0, *breaks.tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = count_below(df, F.col("v"), F.lit(np.array(breaks)), max(size, 1), "n").collect()
    assert [r["n"] for r in out] == [int(np.sum(breaks < v)) for v in values]
