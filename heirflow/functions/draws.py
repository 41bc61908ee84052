"""Random draws keyed by record.

A draw depends only on the record key, the seed and the name of the draw, so it
does not change with partitioning, row order or a recomputed task, and plain SQL
can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13
_SPAN = float(2**52)


def uniform(*key: Column, seed: int, draw: str) -> Column:
    """Uniform on [0, 1): the first 52 bits of md5('key:seed:draw')."""
    text = F.concat_ws(":", *[k.cast("string") for k in key], F.lit(str(seed)), F.lit(draw))
    bits = F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10)
    # 52 bits are exact in a double, and whole numbers are parsed faster
    return bits.cast("long").cast("double") / F.lit(_SPAN)


def normal(*key: Column, seed: int, draw: str) -> Column:
    """Standard normal by Box-Muller from the uniforms '<draw>1' and '<draw>2'."""
    u1 = uniform(*key, seed=seed, draw=f"{draw}1")
    u2 = uniform(*key, seed=seed, draw=f"{draw}2")
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def lognormal(mu: Column, sigma: Column, *key: Column, seed: int, draw: str = "z") -> Column:
    """exp(mu + sigma * z)."""
    return F.exp(mu + sigma * normal(*key, seed=seed, draw=draw))


def pareto(minimum: float, alpha: float, *key: Column, seed: int, draw: str) -> Column:
    """Pareto above ``minimum`` by inverse distribution function."""
    u = uniform(*key, seed=seed, draw=draw)
    return F.lit(minimum) * F.pow(F.lit(1.0) - u, F.lit(-1.0 / alpha))
