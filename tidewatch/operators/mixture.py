"""One against two Gaussian components per group, fitted by aggregations over the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import cut_lineage

# Floors of the fit and its preference margin.
SD_FLOOR = 1e-3
DENSITY_FLOOR = 1e-300
MARGIN = 10.0
# Distinct values that a task of an EM step holds.
VALUES = 500_000


def two_component_bic(df: DataFrame, group: str, x: str, max_iter: int = 500, tol: float = 1e-9) -> DataFrame:
    """Rows ``(group, n, bic_1, bic_2, delta_bic, m1, m2, s1, s2, weight_1, two_component_preferred, iterations)``.

    The lower half of the ordered values starts component one; a fit rests once a step gains less than ``tol`` in log
    likelihood. Every EM step is one job over blocks of distinct values and their counts, of which seven sums for a group reach
    the driver; groups at rest are not computed again.
    """
    data = cut_lineage(df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(group, F.col(x).cast("double").alias("x")))
    c = F.col
    start = _median_split(data, group).withColumns({"pi": F.lit(0.5), "steps": F.lit(0), "ll": F.lit(float("-inf"))})
    fits = {r[group]: r.asDict() for r in start.collect()}
    live = dict(fits)
    for r in fits.values():
        if r["m1"] is None or r["m2"] is None:  # a single value has no halves
            r.update(m1=None, m2=None, s1=SD_FLOOR, s2=SD_FLOOR, pi=None, steps=1, ll=None)
            del live[r[group]]
    blocks = _blocks(data, group) if live else None
    for _ in range(max_iter):
        if not live:
            break
        sums = {r[group]: r for r in _sums(blocks, group, live).collect()}
        for g, r in list(live.items()):
            s = sums[g]
            empty = s["sg"] < 1e-9 or s["sh"] < 1e-9
            if not empty:
                da, db = s["ga"] / s["sg"], s["hb"] / s["sh"]
                r.update(m1=r["m1"] + da, m2=r["m2"] + db, s1=_spread(s["gaa"] / s["sg"], da), s2=_spread(s["hbb"] / s["sh"], db))
            gain = s["ll"] - r["ll"]
            r.update(pi=s["sg"] / r["n"], steps=r["steps"] + 1, ll=s["ll"])
            if empty or gain < tol:
                del live[g]
    params = df.sparkSession.createDataFrame([tuple(r[k] for k in start.columns) for r in fits.values()], T.StructType([T.StructField(k.name, k.dataType) for k in start.schema]))
    model = [group, "pi", "m1", "s1", "m2", "s2"]
    p1 = c("pi") * F.exp(-0.5 * F.pow((c("x") - c("m1")) / c("s1"), 2)) / c("s1")
    p2 = (1 - c("pi")) * F.exp(-0.5 * F.pow((c("x") - c("m2")) / c("s2"), 2)) / c("s2")
    root = math.sqrt(2 * math.pi)
    ll2 = F.sum(F.log(F.greatest((p1 + p2) / root, F.lit(DENSITY_FLOOR))))
    two = data.join(params.select(*model), group).groupBy(group).agg(ll2.alias("ll2"))
    sd = F.greatest("sd", F.lit(1e-9))
    # the sum of squares about the mean is (n - 1) sd^2, so the one-component likelihood needs no second pass
    ll1 = c("n") * (-0.5 * math.log(2 * math.pi) - F.log(sd)) - 0.5 * (c("n") - 1) * F.pow(c("sd") / sd, 2)
    out = params.join(two, group).withColumns({
        "bic_1": -2 * ll1 + 2 * F.log("n"), "bic_2": -2 * c("ll2") + 5 * F.log("n"), "weight_1": c("pi"), "iterations": c("steps")})
    return out.withColumn("delta_bic", c("bic_1") - c("bic_2")).withColumn("two_component_preferred", c("delta_bic") > MARGIN)


def _spread(square: float, mean: float) -> float:
    return max(SD_FLOOR, math.sqrt(max(0.0, square - mean * mean)))


def _blocks(data: DataFrame, group: str) -> DataFrame:
    """Rows ``(group, xs, ns)``: some distinct values of a group and how often each occurs, as arrays of doubles."""
    counts = cut_lineage(data.groupBy(group, "x").agg(F.count(F.lit(1)).cast("double").alias("n")))
    kind = data.schema[group].dataType.simpleString()

    def pack(frames):
        for frame in frames:
            for g, rows in frame.groupby(group):
                yield pd.DataFrame({group: [g], "xs": [rows["x"].to_numpy("<f8").tobytes()], "ns": [rows["n"].to_numpy("<f8").tobytes()]})

    tasks = -(-counts.count() // VALUES) or 1
    return cut_lineage(counts.repartition(tasks).sortWithinPartitions(group).mapInPandas(pack, f"`{group}` {kind}, xs binary, ns binary"))


def _sums(blocks: DataFrame, group: str, fits: dict) -> DataFrame:
    """The sums of an EM step for each group of ``fits``; second moments about the current means keep the squares small."""
    model = {g: tuple(r[k] for k in ("pi", "m1", "s1", "m2", "s2")) for g, r in fits.items()}
    names = ["sg", "sh", "ga", "gaa", "hb", "hbb", "ll"]

    def step(frames):
        for frame in frames:
            out = []
            for g, xs, ns in zip(frame[group], frame["xs"], frame["ns"]):
                if g not in model:
                    continue
                pi, m1, s1, m2, s2 = model[g]
                n, x = np.frombuffer(ns, "<f8"), np.frombuffer(xs, "<f8")
                a, b = x - m1, x - m2
                p1, p2 = pi * np.exp(-0.5 * (a / s1) ** 2) / s1, (1 - pi) * np.exp(-0.5 * (b / s2) ** 2) / s2
                both = np.maximum(p1 + p2, DENSITY_FLOOR)
                w = p1 / both
                one, two = n * w, n * (1 - w)
                out.append((g, one.sum(), two.sum(), one @ a, one @ (a * a), two @ b, two @ (b * b), n @ np.log(both)))
            if out:
                yield pd.DataFrame(out, columns=[group, *names])

    kind = blocks.schema[group].dataType.simpleString()
    per_block = blocks.mapInPandas(step, ", ".join([f"`{group}` {kind}", *(f"{x} double" for x in names)]))
    return per_block.groupBy(group).agg(*[F.sum(x).alias(x) for x in names])


def _median_split(data: DataFrame, group: str) -> DataFrame:
    """Moments of the whole and of the lower and upper ``n // 2`` split.

    The split value comes from an exact percentile; rows equal to it are shared out by count, so the halves have
    the sizes an ordered list would give without ordering one.
    """
    n_split = F.floor(F.count("x") / 2)
    size = data.groupBy(group).agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"),
                                   n_split.alias("nl"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("cut"))
    j = data.join(size, group)
    less, more, same = F.col("x") < F.col("cut"), F.col("x") > F.col("cut"), F.col("x") == F.col("cut")
    d = F.col("x") - F.col("cut")
    m = j.groupBy(group, "n", "mu", "sd", "nl", "cut").agg(
        F.count_if(less).alias("cl"), F.count_if(same).alias("cs"),
        F.coalesce(F.sum(F.when(less, d)), F.lit(0.0)).alias("sl"), F.coalesce(F.sum(F.when(less, d * d)), F.lit(0.0)).alias("ql"),
        F.coalesce(F.sum(F.when(more, d)), F.lit(0.0)).alias("su"), F.coalesce(F.sum(F.when(more, d * d)), F.lit(0.0)).alias("qu"))
    nl, nu = F.col("nl"), F.col("n") - F.col("nl")

    def half(s: str, q: str, k):
        mean = F.try_divide(F.col(s), k)
        return F.col("cut") + mean, F.greatest(F.sqrt(F.greatest(F.try_divide(F.col(q), k) - mean * mean, F.lit(0.0))), F.lit(SD_FLOOR))

    m1, s1 = half("sl", "ql", nl)
    m2, s2 = half("su", "qu", nu)
    return m.select(group, "n", "mu", "sd", m1.alias("m1"), s1.alias("s1"), m2.alias("m2"), s2.alias("s2"))
