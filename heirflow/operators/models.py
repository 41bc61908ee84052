"""Two-part model: chance of an inheritance, then its lognormal amount."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.functions.draws import lognormal
from heirflow.operators.forest import fit_forest, saved_forest  # noqa: F401  (the chance is a forest)
from heirflow.operators.forest import forest_mean as forest_probability  # noqa: F401

TERMS = ("one", "m", "a", "a2", "r", "r2", "a_r", "a2_r", "a_r2", "a2_r2")

# E[ln chi-square(1)] (Harvey 1976): what the log of a squared normal residual lies below ln variance.
_LOG_CHI2_MEAN = -1.2703628454614782


def design(married: str = "married", age: str = "age", rank: str = "income_pctile") -> list[Column]:
    """1, married, quadratics in age and rank, and their products, in the order of ``TERMS``.

    Age and rank are centred and scaled to about [-1, 1]; fitted values do not
    depend on that, only the conditioning of the moments does.
    """
    a = (F.col(age) - F.lit(50.0)) / F.lit(32.0)
    r = (F.col(rank) - F.lit(0.5)) * F.lit(2.0)
    a2, r2 = a * a, r * r
    return [
        F.lit(1.0), F.col(married).cast("double"), a, a2, r, r2, a * r, a2 * r, a * r2, a2 * r2,
    ]


def ols_moments(df: DataFrame, y: Column, terms: Sequence[Column] | None = None) -> DataFrame:
    """Upper triangle of the sums of products of (terms, y): one row per pair i <= j.

    One aggregation with map-side partial sums, 66 numbers for the standard design.
    """
    terms = [*(terms or design()), y]
    names = [f"_t{i}" for i in range(len(terms))]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    # Rows with a missing term would only thin out some of the sums.
    rows = df.select(*[t.alias(n) for t, n in zip(terms, names)]).dropna()
    sums = rows.selectExpr(*[f"sum(_t{i} * _t{j}) AS _s{i}_{j}" for i, j in pairs])
    entries = ", ".join(f"struct({i} AS i, {j} AS j, _s{i}_{j} AS moment)" for i, j in pairs)
    return sums.selectExpr(f"inline(array({entries}))")


def fit_ols(df: DataFrame, y: Column, terms: Sequence[Column] | None = None) -> list[float]:
    """Least-squares coefficients, from moments; the smallest ones where terms are collinear."""
    k = len(terms or TERMS)
    moments = np.zeros((k + 1, k + 1))
    for row in ols_moments(df, y, terms).collect():  # (k + 1)(k + 2) / 2 numbers
        moments[row["i"], row["j"]] = moments[row["j"], row["i"]] = row["moment"] or 0.0
    coefficients, *_ = np.linalg.lstsq(moments[:k, :k], moments[:k, k], rcond=1e-13)
    return coefficients.tolist()


def linear(coefficients: Sequence[float], terms: Sequence[Column] | None = None) -> Column:
    """Linear predictor as a column."""
    total = F.lit(0.0)
    for c, t in zip(coefficients, terms or design()):
        total = total + F.lit(float(c)) * t
    return total


@dataclass(frozen=True)
class AmountModel:
    """Log amount is normal with mean ``mu`` and log variance ``log_variance``, both linear."""

    mu: list[float]
    log_variance: list[float]
    log_variance_shift: float = 0.0


def fit_amounts(
    df: DataFrame, value: str = "inheritance", harvey_correction: bool = False
) -> AmountModel:
    """Regress log of positive values, then the log of the squared residuals.

    The second regression fits a sd that is biased low; ``harvey_correction``
    shifts the log variance to make up for it. Rows whose residual is exactly 0 have no
    logarithm and are left out of it.
    """
    rows = df.where(F.col(value) > 0)
    y = F.ln(F.col(value))
    mu = fit_ols(rows, y)
    residual = y - linear(mu)
    log_variance = fit_ols(rows.where(residual != 0), F.ln(residual * residual))
    return AmountModel(mu, log_variance, -_LOG_CHI2_MEAN if harvey_correction else 0.0)


def predict_amounts(df: DataFrame, model: AmountModel) -> DataFrame:
    """Add ``mu_pred`` and ``sigma_pred``."""
    log_variance = linear(model.log_variance) + F.lit(model.log_variance_shift)
    return df.withColumn("mu_pred", linear(model.mu)).withColumn(
        "sigma_pred", F.sqrt(F.exp(log_variance))
    )


def impute_amounts(
    df: DataFrame,
    seed: int,
    key: Sequence[str] = ("id",),
    mu: str = "mu_pred",
    sigma: str = "sigma_pred",
    out: str = "inheritance",
) -> DataFrame:
    """Draw a lognormal amount for each record."""
    draw = lognormal(F.col(mu), F.col(sigma), *[F.col(k) for k in key], seed=seed)
    return df.withColumn(out, draw)
