"""Tail, segment and recovery summaries of per-cycle series, and end-state distributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.rolling import array_columns, series_arrays


def window_mean(x: str, lo: int, hi: int) -> Column:
    """Aggregate: mean of the known values of cycles ``[lo, hi)``."""
    return F.avg(F.when((F.col("cycle") >= lo) & (F.col("cycle") < hi), F.col(x)))


def recovery_fit(series: DataFrame, keys: Sequence[str], x: str, shock: int, n_cycles: int, before: int = 25,
                 span: int = 60, tail: int = 30) -> DataFrame:
    """Exponential return after a shock: rate and R-squared of ln|deviation| against time, and the end state.

    The level before the shock is a small aggregate joined back on the run; points closer than 0.001 to it are
    left out and at least eight are needed.
    """
    keys = list(keys)
    level = series.groupBy(*keys).agg(window_mean(x, shock - before, shock).alias("z_star"),
                                      window_mean(x, n_cycles - tail, n_cycles).alias("z_end"))
    seg = series.where((F.col("cycle") >= shock) & (F.col("cycle") < shock + span)).join(level, keys)
    dev = F.abs(F.col("z_star") - F.col(x))
    y, t = F.when(dev > 1e-3, F.ln(dev)), F.when(dev > 1e-3, (F.col("cycle") - shock).cast("double"))
    enough = F.count(y) >= 8
    fit = seg.groupBy(*keys).agg(
        F.count(y).alias("n_points"), F.when(enough, -F.regr_slope(y, t)).alias("recovery_rate"),
        F.when(enough & (F.regr_syy(y, t) > 1e-12), F.regr_r2(y, t)).alias("fit_r2"))
    return level.join(fit, keys, "left").withColumn("returned", F.col("z_end") > 0.6 * F.col("z_star"))


def tail_state(series: DataFrame, keys: Sequence[str], x: str, n_cycles: int, tail: int = 60) -> DataFrame:
    """Mean, spread and lag-1 correlation of the last ``tail`` cycles."""
    last = series.where(F.col("cycle") >= n_cycles - tail).withColumn("_p", F.lag(x).over(W.partitionBy(*keys).orderBy("cycle")))
    both = F.col("_p").isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col("_p")), F.when(both, F.col(x))
    return last.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
        F.when((F.count(b) > 3) & (F.stddev_pop(F.col(x)) > 1e-12), F.corr(a, b)).alias("ac1"))


def indicator_vs_latent(joined: DataFrame, keys: Sequence[str], indicator: str, latent: str, start: int, n_cycles: int,
                        level: float, smooth: int = 20, min_length: int = 40, min_points: int = 20) -> DataFrame:
    """Rank correlation of the published (trailing-mean) indicator with a latent driver until it crosses ``level``.

    The segment runs from ``start`` to the first crossing but at least ``min_length`` cycles. Values are ranked at
    nine decimals, where ties are ties in any order of addition.
    """
    r = _followed(joined, keys, [indicator], latent, start, n_cycles, level, smooth, min_length, min_points)
    return r.select(*keys, "stop", F.when(F.col("n0") > 0, F.col("n0")).alias("n"), F.when(F.col("n0") >= min_points, F.col("rho0")).alias("rho"))


def indicator_legs(joined: DataFrame, keys: Sequence[str], indicators: dict[str, str], latent: str, start: int, n_cycles: int, level: float,
                   smooth: int = 20, min_length: int = 40, min_points: int = 20) -> DataFrame:
    """The three ways a driver is compared: rows ``(keys…, n_raw, pearson_raw, <name>…)``.

    ``indicators`` names published columns; each is ranked by its trailing mean as in :func:`indicator_vs_latent`. The first
    is also correlated as it is, without smoothing or ranks, given enough points that differ.
    """
    r = _followed(joined, keys, list(indicators.values()), latent, start, n_cycles, level, smooth, min_length, min_points)
    return r.select(*keys, "stop", "n_raw", "pearson_raw", *[
        F.when(F.col(f"n{i}") >= min_points, F.col(f"rho{i}")).alias(name) for i, name in enumerate(indicators)])


def _followed(joined: DataFrame, keys: Sequence[str], indicators: Sequence[str], latent: str, start: int, n_cycles: int, level: float,
              smooth: int, min_length: int, min_points: int) -> DataFrame:
    """Rows ``(keys…, stop, n_raw, pearson_raw, n0, rho0, n1, …)``, each run worked on as the arrays of one row."""
    def trailing(x: np.ndarray) -> np.ndarray:
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(smooth - 1, np.nan), x]), smooth)
        known = ~np.isnan(frames)
        n = known.sum(axis=1)
        return np.divide(np.where(known, frames, 0.0).sum(axis=1), n, out=np.full(len(x), np.nan), where=n >= max(3, smooth // 3))

    def ranks(x: np.ndarray) -> np.ndarray:
        _, which, n = np.unique(x, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - n + (n + 1) / 2)[which]

    def correlation(a: np.ndarray, b: np.ndarray, least: float) -> float | None:
        da, db = a - a.mean(), b - b.mean()
        va, vb = (da * da).mean(), (db * db).mean()
        return (da * db).mean() / np.sqrt(va * vb) if min(va, vb) >= least else None

    def one(cycle: np.ndarray, driver: np.ndarray, *xs: np.ndarray) -> tuple:
        crossed = cycle[driver <= level]
        stop = max(start + min_length, int(crossed.min()) if len(crossed) else n_cycles)
        inside = (cycle >= start) & (cycle < stop)
        d, xs = driver[inside], [x[inside] for x in xs]
        raw = ~np.isnan(xs[0]) & ~np.isnan(d)
        out = [stop, int(raw.sum()), correlation(xs[0][raw], d[raw], 1e-24) if raw.sum() >= min_points else None]
        for x in xs:
            a, b = np.round(trailing(x), 9), np.round(d, 9)
            both = ~np.isnan(a) & ~np.isnan(b)
            out += [int(both.sum()), correlation(ranks(a[both]), ranks(b[both]), 1e-12) if both.any() else None]
        return tuple(out)

    kinds = ["stop int", "n_raw bigint", "pearson_raw double", *[f"n{i} bigint, rho{i} double" for i in range(len(indicators))]]
    names = [k.split()[0] for k in ", ".join(kinds).split(", ")]

    @F.pandas_udf(f"struct<{', '.join(kinds).replace(' ', ': ').replace(',: ', ', ')}>")
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = [one(np.asarray(r[0]), *[np.asarray(x, np.float64) for x in r[1:]]) for r in rows.itertuples(index=False)]
        return pd.DataFrame(found, columns=names)

    values = {"driver": latent} | {f"x{i}": c for i, c in enumerate(indicators)}
    cols = list(dict.fromkeys([latent, *indicators]))
    return series_arrays(joined, keys, cols).select(*keys, compare(array_columns(values)).alias("_c")).select(*keys, "_c.*")


def largest_gap(df: DataFrame, by: Sequence[str], x: str, buckets: int = 256) -> DataFrame:
    """Widest gap between neighbouring values of each group, without ordering a group in one task.

    Gaps inside equal parts of the range come from a lag; gaps between parts from their smallest and largest values.
    """
    by = list(by)
    v = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x")).distinct()
    span = v.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (buckets - 1)), F.lit(0))
    placed = v.join(span, by).withColumn("_b", part)
    inner = placed.withColumn("_g", F.col("_x") - F.lag("_x").over(W.partitionBy(*by, "_b").orderBy("_x")))
    parts = inner.groupBy(*by, "_b").agg(F.max("_g").alias("_g"), F.min("_x").alias("_a"), F.max("_x").alias("_z"))
    across = F.lead("_a").over(W.partitionBy(*by).orderBy("_b")) - F.col("_z")
    return parts.withColumn("_c", across).groupBy(*by).agg(
        F.greatest(F.max("_g"), F.max("_c")).alias("largest_gap"), (F.max("_z") - F.min("_a")).alias("range"))


def branch_summary(cells: DataFrame, by: str, gap: float) -> DataFrame:
    """Jump, fold midpoint, transition width and bistable window of two branches along a design axis.

    ``cells`` has one row per (by, a) with ``upper`` and ``lower`` branch means and the upper branch's spread.
    """
    w = W.partitionBy(by)
    desc = w.orderBy(F.col("a").desc())
    top, bottom = F.first("upper").over(desc), F.last("upper").over(desc.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rng = F.greatest(F.lit(1e-9), top - bottom)
    c = cells.withColumns({
        "drop": F.col("upper") - F.lead("upper").over(desc), "next_a": F.lead("a").over(desc),
        "frac": (F.col("upper") - bottom) / rng, "rng": rng})
    inner = F.when((F.col("frac") > 0.15) & (F.col("frac") < 0.85), F.col("a"))
    both = F.when(F.col("upper") - F.col("lower") > gap, F.col("a"))
    best = F.struct("drop", "a", "next_a")
    return c.groupBy(by).agg(
        F.max_by(best, best).alias("j"), F.max("rng").alias("rng"), F.coalesce(F.max(inner) - F.min(inner), F.lit(0.0)).alias("transition_width"),
        F.count(both).alias("n_bistable"), F.coalesce(F.max(both) - F.min(both), F.lit(0.0)).alias("bistable_width"),
        F.max(F.col("upper") - F.col("lower")).alias("max_gap"), F.min_by("a", F.struct(F.abs(F.col("frac") - 0.5), -F.col("a"))).alias("a_mid"),
        F.max_by("a", F.struct("sd", "a")).alias("peak_sd_at"),
    ).select(by, F.col("j.drop").alias("jump"), (F.col("j.drop") / F.col("rng")).alias("jump_relative"),
             (0.5 * (F.col("j.a") + F.col("j.next_a"))).alias("fold_midpoint"), "transition_width", "n_bistable", "bistable_width",
             "max_gap", "a_mid", "peak_sd_at")
