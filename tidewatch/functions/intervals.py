"""Rates, intervals and test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.columns import col

# Fixed value: the 97.5 % point of the standard normal distribution.
Z95 = 1.959963984540054
# Fixed value: the 80 % point, for minimum detectable effects.
Z80 = 0.8416212335729143


def rate(flag: Column | str) -> Column:
    """Aggregate: share of TRUE among non-NULL flags."""
    return F.avg(col(flag).cast("double"))


def wilson(k: Column | str, n: Column | str, side: int) -> Column:
    """Bound of the Wilson 95 % interval: ``side`` -1 lower, +1 upper. ``k`` may be fractional; n = 0 gives NULL."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    z2n = F.try_divide(F.lit(Z95 * Z95), n)
    centre = p + z2n / 2
    half = F.lit(Z95) * F.sqrt(F.try_divide(F.greatest(p * (1 - p), F.lit(0.0)), n) + z2n / (4 * n))
    return F.when(n > 0, (centre + side * half) / (1 + z2n))


def wilson_sql(k: str, n: str, side: int) -> str:
    z = Z95
    return (f"(CASE WHEN {n} > 0 THEN ((1.0*{k}/{n}) + {z * z}/(2.0*{n}) {'+' if side > 0 else '-'} {z} * "
            f"sqrt(greatest((1.0*{k}/{n})*(1-(1.0*{k}/{n})), 0)/{n} + {z * z}/(4.0*{n}*{n}))) / (1 + {z * z}/{n}) END)")


def two_proportion_z(k1: Column | str, n1: Column | str, k2: Column | str, n2: Column | str) -> Column:
    """Pooled two-proportion z; NULL when either side is empty or the pooled variance is zero."""
    k1, n1, k2, n2 = (col(x).cast("double") for x in (k1, n1, k2, n2))
    p = F.try_divide(k1 + k2, n1 + n2)
    se = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.try_divide(k1 / n1 - k2 / n2, se)


def chi2_term(k: Column | str, n: Column | str, p: Column | str) -> Column:
    """One cell's share of the heterogeneity chi-square at pooled rate ``p``."""
    k, n, p = col(k), col(n), col(p)
    e = n * p
    return F.when((p > 0) & (p < 1), F.try_divide((k - e) * (k - e), e * (1 - p)))


def verdict(lo: Column | str, hi: Column | str) -> Column:
    lo, hi = col(lo), col(hi)
    return F.when(lo > 0, "beats").when(hi < 0, "loses").when(lo.isNotNull() & hi.isNotNull(), "matches")


def excludes_zero(lo: Column | str, hi: Column | str) -> Column:
    return (col(lo) > 0) | (col(hi) < 0)
