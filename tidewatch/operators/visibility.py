"""Visibility masks, their consequences for what is recorded, and corrections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import clip, logistic, p_observed, shrink, unit_hash
from tidewatch.session import cut_lineage

# Fixed values of the masks and the correction.
BISECTION_STEPS = 80
RIDGE = 1e-3
REVOCATION_SLOPE = 0.8


def mcar(node: str, coverage: float, tag: str = "supplier") -> Column:
    """Visible completely at random."""
    return unit_hash(tag, node) < coverage


def calibrate_intercept(z: DataFrame, beta: float, target: float, x: str = "z", levels: str = "level") -> float:
    """Intercept a with mean(logistic(beta x + a)) = target, by bisection.

    The rows are first counted per distinct ``levels`` value (an integer degree, so few). The midpoints of six
    bisections form a tree of 63, which one job evaluates together by spreading that small table over them.
    """
    hist = cut_lineage(z.groupBy(levels).agg(F.first(x).alias("x"), F.count(F.lit(1)).alias("n")))
    lo, hi, steps = -40.0, 40.0, 0
    while steps < BISECTION_STEPS:
        take = min(6, BISECTION_STEPS - steps)
        steps += take
        cuts = sorted({lo + (hi - lo) * i / 2**take for i in range(1, 2**take)} - {lo, hi})
        if not cuts:  # neighbouring doubles: nothing left to halve
            break
        a = F.explode(F.array(*[F.lit(c) for c in cuts]))
        means = hist.withColumn("a", a).groupBy("a").agg(
            (F.sum(F.col("n") * logistic(F.lit(beta) * F.col("x") + F.col("a"))) / F.sum("n")).alias("m"))
        below = means.where(F.col("m") < target).count()
        lo, hi = ([lo] + cuts)[below], (cuts + [hi])[below]
    return 0.5 * (lo + hi)


def mnar(z: DataFrame, beta: float, coverage: float, tag: str, node: str = "node", levels: str = "level") -> DataFrame:
    """Add ``p`` and ``visible``: better connected nodes are more visible, the mean set to ``coverage``."""
    a = calibrate_intercept(z, beta, coverage, levels=levels)
    return z.withColumn("p", logistic(F.lit(beta) * F.col("z") + F.lit(a))).withColumn(
        "visible", unit_hash(tag, node) < F.col("p"))


def weighted_sample(df: DataFrame, node: str, weight: Column, k: int, tag: str) -> DataFrame:
    """``k`` rows without replacement with chances following ``weight``: the smallest exponential arrival times.

    ``orderBy().limit(k)`` keeps k rows per task and merges those, it never orders the table.
    """
    arrival = -F.ln(F.greatest(unit_hash(tag, node), F.lit(2.0**-33))) / weight
    return df.withColumn("_arrival", arrival).orderBy("_arrival", node).limit(k).drop("_arrival")


def two_streams(log: DataFrame, by: Sequence[str], value: Column, published: Column, revised: Column) -> DataFrame:
    """As-published and re-derived cycle means from one scan; an empty re-derived cycle keeps the published value."""
    pub, rev = F.avg(F.when(published, value)), F.avg(F.when(revised, value))
    return log.groupBy(*by).agg(pub.alias("published"), F.coalesce(rev, pub).alias("revised"),
                                F.count_if(published).alias("n_published"), F.count_if(revised).alias("n_revised"))


def recorded_value(value: Column, k: Column, m: Column) -> Column:
    """What an observer of k of m members records: the shortened span, or nothing below two members."""
    return F.when(k >= 2, value * shrink(k, m))


def ipw_mean(log: DataFrame, by: Sequence[str], k: str, recorded: str, p_hat: Column) -> DataFrame:
    """Cycle means corrected by an observer who knows only the visible members and a propensity.

    Team size is inferred as k / p, the shortening undone at that size, and each event weighted by the inverse
    chance of having been observed at all.
    """
    p = clip(p_hat, 0.05, 0.999)
    m_hat = F.greatest(F.col(k).cast("double"), F.col(k) / p)
    x = F.col(recorded) / shrink(F.col(k), m_hat)
    w = 1.0 / p_observed(m_hat, p)
    return log.where(F.col(recorded).isNotNull()).groupBy(*by).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("corrected"))


def propensity_fit(nodes: DataFrame, visible: str, level: str, iters: int = 200, tol: float = 1e-8) -> dict[str, float]:
    """Ridge-penalised logistic fit of visibility on the standardised level by Newton steps.

    Rows are counted per level once; a step is one aggregation to the sums of a 2 x 2 system, which is all the
    driver sees.
    """
    hist = nodes.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.count_if(visible).alias("k"))
    total, s1, s2 = F.sum("n"), F.sum(F.col("n") * F.col(level)), F.sum(F.col("n") * F.col(level) * F.col(level))
    hist = cut_lineage(hist)
    m = hist.agg(total.alias("n"), (s1 / total).alias("mean"), F.sqrt(F.greatest(s2 / total - (s1 / total) * (s1 / total), F.lit(0.0))).alias("sd")).first()
    sd = m["sd"] if m["sd"] > 1e-9 else 1.0
    x = (F.col(level) - F.lit(m["mean"])) / F.lit(sd)
    w0 = w1 = 0.0
    for _ in range(iters):
        p = logistic(clip(F.lit(w0) + F.lit(w1) * x, -30.0, 30.0))
        r, v = F.col("k") - F.col("n") * p, F.col("n") * (p * (1 - p) + 1e-9)
        s = hist.agg(F.sum(r).alias("g0"), F.sum(r * x).alias("g1"), F.sum(v).alias("a"), F.sum(v * x).alias("b"), F.sum(v * x * x).alias("c")).first()
        g0, g1 = s["g0"] - RIDGE * w0, s["g1"] - RIDGE * w1
        a, b, c = s["a"] + RIDGE, s["b"], s["c"] + RIDGE
        det = a * c - b * b
        d0, d1 = (c * g0 - b * g1) / det, (a * g1 - b * g0) / det
        w0, w1 = w0 + d0, w1 + d1
        if max(abs(d0), abs(d1)) < tol:
            break
    return {"intercept": w0, "slope": w1, "mean": m["mean"], "sd": sd}


def propensity(fit: dict[str, float], level: str) -> Column:
    """Predicted visibility, kept within [0.02, 1]."""
    eta = F.lit(fit["intercept"]) + F.lit(fit["slope"]) * (F.col(level) - F.lit(fit["mean"])) / F.lit(fit["sd"])
    return clip(logistic(clip(eta, -30.0, 30.0)), 0.02, 1.0)


def displacement(a: Column, b: Column, k: float) -> dict[str, Column]:
    """Aggregates comparing two scores over jointly known cycles: size, level, shape and alarm-status flips."""
    both = a.isNotNull() & b.isNotNull()
    d = F.when(both, b - a)
    n = F.count(d)
    flip = F.when(both, ((a >= k) != (b >= k)).cast("double"))
    return {"n": n, "mean_abs": F.avg(F.abs(d)), "level": F.avg(d), "shape_sd": F.when(n > 2, F.stddev_samp(d)), "flip_frac": F.avg(flip)}
