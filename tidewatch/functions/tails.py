"""Tail probabilities, applied to result tables of a few rows.

Spark SQL has no ``erfc``; these are the only Python functions in the statistics and they see one batch per task of
already aggregated rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _normal(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def _chi2(x: float | None, df: float | None) -> float | None:
    """Upper tail for whole ``df``: finite sums, started by exp for even and erfc for odd degrees of freedom."""
    if x is None or df is None or math.isnan(x) or math.isnan(df) or df < 1:
        return None
    if x <= 0:
        return 1.0
    half, odd = x / 2.0, int(df) % 2
    tail = math.erfc(math.sqrt(half)) if odd else math.exp(-half)
    # each step raises the degrees of freedom by two: Q(a + 1) = Q(a) + half^a e^-half / gamma(a + 1)
    a = 0.5 if odd else 1.0
    while a < df / 2.0:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1.0))
        a += 1.0
    return min(1.0, tail)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.astype("float64").map(_normal).astype("float64")


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with ``df`` degrees of freedom >= x)."""
    return pd.Series([_chi2(a, b) for a, b in zip(x.astype("float64"), df.astype("float64"))], dtype="float64")


def normal_two_sided_sql(z: str) -> str:
    """The same in DuckDB through the all-positive series of erf."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = (f"list_sum(list_transform(range(0, 120), lambda n: CASE WHEN {x} = 0 THEN 0.0 ELSE exp((2*n+1)*ln({x}) "
              f"+ n*ln(2.0) - (lgamma(2*n+2) - n*ln(2.0) - lgamma(n+1))) END))")
    return f"(CASE WHEN {z} IS NOT NULL THEN greatest(0.0, 1 - 2/sqrt(pi())*exp(-{x}*{x})*{series}) END)"


def chi2_upper_sql(x: str, df: str) -> str:
    """The same in DuckDB through the lower incomplete gamma series."""
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 400), "
            f"lambda n: exp(({df}/2.0 + n)*ln({x}/2.0) - {x}/2.0 - lgamma({df}/2.0 + n + 1))))) END)")
