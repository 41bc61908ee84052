"""Column expressions: null rules, keyed random draws, stepwise lookups."""

from heirflow.functions.arrays import count_below
from heirflow.functions.draws import lognormal, normal, pareto, uniform
from heirflow.functions.nulls import greatest_or_null, least_or_null, required

__all__ = [
    "count_below",
    "greatest_or_null",
    "least_or_null",
    "lognormal",
    "normal",
    "pareto",
    "required",
    "uniform",
]
