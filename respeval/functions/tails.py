"""Tail probabilities Spark has no function for.

They run after aggregation, on one row per compared pair. The helpers sit
inside the builder so that workers need no copy of this package.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _build():
    def log_gamma_step(a: float) -> float:
        """log Gamma(a + 1/2) - log Gamma(a), without taking a difference of large numbers."""
        down = 0.0
        while a < 20.0:
            down += math.log1p(0.5 / a)
            a += 1.0
        b = 1.0 / a
        series = b * (-1 / 8 + b * b * (1 / 192 + b * b * (-1 / 640 + b * b * 17 / 14336)))
        return 0.5 * math.log(a) + series - down

    # Nodes of the double-exponential rule for integrals to infinity: its sums converge
    # for every tail, from 1/u^2 (one degree of freedom) to that of the normal density.
    step = 1.0 / 64
    w = np.arange(-4.5, 4.5, step)
    nodes = np.exp(math.pi / 2 * np.sinh(w))
    masses = step * math.pi / 2 * np.cosh(w) * nodes

    def t_tail(t, df):
        if t is None or df is None or t != t or df != df or df <= 0:
            return None
        u = abs(t) + nodes
        log_scale = log_gamma_step(df / 2.0) - 0.5 * math.log(df * math.pi)
        # u / sqrt(df) is squared, not u, so that nothing overflows.
        bent = np.log1p(np.square(u / math.sqrt(df)))
        density = np.exp(log_scale - (df + 1.0) / 2.0 * bent)
        return min(1.0, 2.0 * float(np.sum(masses * density)))

    def chi2_tail(x):
        if x is None or x != x:
            return None
        return math.erfc(math.sqrt(max(x, 0.0) / 2.0))

    def chi2_series(x: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(v) for v in x], dtype="float64")

    def t_series(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_tail(a, b) for a, b in zip(t, df)], dtype="float64")

    return F.pandas_udf(chi2_series, "double"), F.pandas_udf(t_series, "double")


def _null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def chi2_p(statistic: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return _null_if_nan(_build()[0](statistic.cast("double")))


def t_p(statistic: Column, degrees: Column) -> Column:
    """Two-sided tail of Student's t distribution."""
    return _null_if_nan(_build()[1](statistic.cast("double"), degrees.cast("double")))
