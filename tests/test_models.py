import numpy as np
import pytest
from pyspark.sql import functions as F

from heirflow.operators import models


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    age, married, rank = rng.integers(18, 81, n), rng.integers(0, 2, n), rng.integers(0, 101, n) / 100
    mu = 9 + 0.02 * age + 0.3 * married + rank**2
    sd = np.exp(0.1 * married - 0.2)
    value = np.exp(mu + sd * rng.standard_normal(n))
    has = (rng.random(n) < 0.02 + 0.3 * (age > 50) + 0.2 * (rank > 0.8)).astype(int)
    rows = [
        (i, int(a), int(m), float(r), float(v * h), int(h))
        for i, (a, m, r, v, h) in enumerate(zip(age, married, rank, value, has))
    ]
    return spark.createDataFrame(
        rows,
        "id long, age int, married int, income_pctile double, inheritance double, has_inheritance int",
    ).cache()


def plain_design(rows, centred):
    a = np.array([r["age"] for r in rows], float)
    m = np.array([r["married"] for r in rows], float)
    r = np.array([x["income_pctile"] for x in rows], float)
    if centred:
        a, r = (a - 50) / 32, (r - 0.5) * 2
    return np.column_stack(
        [np.ones_like(a), m, a, a * a, r, r * r, a * r, a * a * r, a * r * r, a * a * r * r]
    )


def test_fitted_values_equal_least_squares_on_raw_powers(frame):
    rows = frame.where("inheritance > 0").collect()
    y = np.log([r["inheritance"] for r in rows])
    x = plain_design(rows, centred=False)
    x = x / np.abs(x).max(axis=0)
    expected = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    coefficients = models.fit_ols(frame.where("inheritance > 0"), F.ln("inheritance"))
    got = plain_design(rows, centred=True) @ np.array(coefficients)
    assert got == pytest.approx(expected, abs=1e-6)


def test_residuals_are_orthogonal_to_every_term(frame):
    rows = frame.where("inheritance > 0")
    residual = F.ln("inheritance") - models.linear(models.fit_ols(rows, F.ln("inheritance")))
    sums = rows.agg(*[F.sum(residual * t) for t in models.design()]).first()
    assert list(sums) == pytest.approx([0.0] * len(models.TERMS), abs=1e-6)


def test_moments_cover_the_triangle(frame):
    moments = models.ols_moments(frame.where("inheritance > 0"), F.ln("inheritance")).collect()
    assert len(moments) == 66
    first = next(r for r in moments if (r["i"], r["j"]) == (0, 0))
    assert first["moment"] == frame.where("inheritance > 0").count()


def test_collinear_terms_do_not_break_the_fit(frame):
    rows = frame.where("inheritance > 0 and married = 1")
    fitted = models.fit_ols(rows, F.ln("inheritance"))
    residual = F.ln("inheritance") - models.linear(fitted)
    assert rows.agg(F.avg(residual)).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_amount_model(frame):
    plain = models.fit_amounts(frame)
    corrected = models.fit_amounts(frame, harvey_correction=True)
    sd = {
        name: models.predict_amounts(frame, m).agg(F.avg("sigma_pred")).first()[0]
        for name, m in (("plain", plain), ("corrected", corrected))
    }
    assert sd["corrected"] / sd["plain"] == pytest.approx(np.exp(1.2703628 / 2), rel=1e-6)
    assert 0.7 < sd["corrected"] < 1.1  # true average is about 0.86
    drawn = models.impute_amounts(models.predict_amounts(frame, corrected), seed=8)
    gap = drawn.select(F.avg(F.ln("inheritance") - F.col("mu_pred"))).first()[0]
    assert abs(gap) < 0.06


def test_forest(spark, frame, tmp_path):
    path = str(tmp_path / "forest")
    model = models.saved_forest(frame, path, True, seed=1, trees=10, depth=6)
    scored = models.forest_probability(frame, model)
    assert scored.columns == [*frame.columns, "p_inheritance"]
    stats = scored.agg(F.min("p_inheritance"), F.max("p_inheritance"), F.avg("p_inheritance"), F.avg("has_inheritance")).first()
    assert 0 <= stats[0] and stats[1] <= 1
    assert stats[2] == pytest.approx(stats[3], abs=0.02)
    old = scored.where("age > 50").agg(F.avg("p_inheritance")).first()[0]
    assert old > scored.where("age <= 50").agg(F.avg("p_inheritance")).first()[0] + 0.2
    again = models.saved_forest(frame, path, False, seed=1)
    assert again.getNumTrees == 10
    first = scored.orderBy("id").limit(50).collect()
    assert first == models.forest_probability(frame, again).orderBy("id").limit(50).collect()
