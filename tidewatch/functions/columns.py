"""Scalar building blocks as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus (2^31 - 1) and multiplier of the integer mixing used for resampling slots.
MIX_MODULUS = 2147483647
MIX_MULTIPLIER = 48271


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round to ``digits`` decimals; engines add doubles in different orders."""
    return F.round(col(c).cast("double"), digits)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only 'missing' used inside the library."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def day_cycle(ts: Column | str, origin: str, days: int = 1) -> Column:
    """Whole cycles of ``days`` days since the date ``origin``."""
    return F.floor(F.datediff(col(ts), F.lit(origin).cast("date")) / F.lit(days)).cast("int")


def hour_cycle(ts: Column | str, origin: str) -> Column:
    """Whole hours since midnight of the date ``origin``."""
    return (F.datediff(col(ts), F.lit(origin).cast("date")) * 24 + F.hour(col(ts))).cast("int")


def censored(t: Column | str, horizon: Column | int) -> Column:
    """An alarm that never fired counts as the horizon."""
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    return F.coalesce(col(t), h)


def firing_pattern(t_lead: Column | str, t_lag: Column | str) -> Column:
    a, b = col(t_lead).isNotNull(), col(t_lag).isNotNull()
    return (F.when(a & b, "both_fired").when(a, "lead_only").when(b, "lag_only").otherwise("neither"))


def stable_key(*parts: Column | str, hex_digits: int = 12, modulus: int = 900000, offset: int = 0) -> Column:
    """Reproducible integer key from text parts: leading hex digits of sha256 of ``a|b|…``, modulo."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    head = F.substring(F.sha2(text, 256), 1, hex_digits)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(modulus)) + F.lit(offset)


def unit_digits(tag: str, *parts: Column | str) -> Column:
    """The eight md5 hex digits of :func:`unit_hash`, as text."""
    text = F.concat_ws("|", F.lit(tag), *[col(p).cast("string") for p in parts])
    return F.substring(F.md5(text), 1, 8)


def unit_hash(tag: str, *parts: Column | str) -> Column:
    """Uniform [0,1) number fixed by ``tag`` and the parts: eight md5 hex digits over 2^32."""
    return F.conv(unit_digits(tag, *parts), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(x: Column) -> Column:
    """Three rounds of square-and-multiply mixing modulo a prime; every product stays below 2^63."""
    m, a = F.lit(MIX_MODULUS).cast("bigint"), F.lit(MIX_MULTIPLIER).cast("bigint")
    x = (x.cast("bigint") * a + F.lit(12345)) % m
    for _ in range(3):
        x = ((x * x) % m + x * a) % m
    return x


def mixed_sql(x: str) -> str:
    """The DuckDB text of :func:`mixed`: the SQL check has to draw the same slots."""
    start = f"(CAST({x} AS BIGINT) * {MIX_MULTIPLIER} + 12345) % {MIX_MODULUS}"
    return (f"list_reduce([{start}, 0, 0, 0], "
            f"lambda x, y: ((x * x) % {MIX_MODULUS} + x * {MIX_MULTIPLIER}) % {MIX_MODULUS})")


def shrink(k: Column | str, m: Column | str) -> Column:
    """Span shrinkage of a group of ``m`` seen through ``k`` members; 1 when fully seen."""
    k, m = col(k).cast("double"), col(m).cast("double")
    return F.when((k >= m) | (m <= 1), F.lit(1.0)).otherwise((k / (k + 1)) / (m / (m + 1)))


def p_observed(m: Column | str, p: Column | float) -> Column:
    """P(at least two of ``m`` members visible) at visibility ``p``, floored at 0.001."""
    m, p = col(m).cast("double"), p if isinstance(p, Column) else F.lit(p)
    q = 1.0 - p
    return F.greatest(F.lit(1e-3), 1.0 - F.pow(q, m) - m * p * F.pow(q, m - 1.0))


def logistic(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` alone would turn it into a bound)."""
    c = col(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def relative_swing(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when(F.abs(a) >= 1e-12, F.try_divide(a - b, a))


def ramp_cycle(value: Column | float, start: int, end: int, high: float, low: float) -> Column:
    """Cycle at which a linear ramp from ``high`` at ``start`` to ``low`` at ``end`` passes ``value``."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.round(F.lit(start) + F.lit(end - start) * (F.lit(high) - v) / F.lit(high - low)).cast("int")


def combine_legs(z_var: Column, z_ac: Column, how: str) -> Column:
    """``and`` = the smaller leg, ``mean`` = their mean, ``var_only``; NULL if a needed leg is NULL."""
    if how == "var_only":
        return z_var
    if how == "mean":
        return 0.5 * (z_var + z_ac)
    if how == "and":
        return F.when(z_var.isNotNull() & z_ac.isNotNull(), F.least(z_var, z_ac))
    raise ValueError(f"unknown combination {how!r}")


def null_safe_mean(cols: Iterable[Column]) -> Column:
    """Mean over the non-NULL members of a fixed list of columns, NULL if all are NULL."""
    cols = list(cols)
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    s = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(s, n)
