"""Poisson log-likelihoods and the normal tail, as column expressions and vectorised functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma, na_action="ignore").astype(float)


def log_factorial(n: Column) -> Column:
    """By summing logarithms up to 256, and by Stirling's series above, where it is exact to twelve digits."""
    n = n.cast("int")
    summed = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    x = n.cast("double") + 1
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 2, 0.0).when(n <= 256, summed).otherwise(stirling)


def log_poisson(count: Column, rate: Column, penalty: float) -> Column:
    """count ln(rate) - rate - ln(count!); a rate of zero counts as the penalty."""
    rate = F.when(rate <= 0, penalty).otherwise(rate).cast("double")
    return count * F.log(rate) - rate - log_factorial(count)
