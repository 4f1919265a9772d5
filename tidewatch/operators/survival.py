"""Alarm times as censored durations: restricted means, incidence, win probability, censoring shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import firing_pattern


def restricted_mean(t: str, tau: Column | int, horizon: str = "n_cycles") -> Column:
    """Aggregate: mean of min(t, tau) with never-fired runs at the horizon."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    return F.avg(F.least(F.coalesce(F.col(t), F.col(horizon)), tau).cast("double"))


def restricted_means(runs: DataFrame, by: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Rows ``(by…, tau, rmta_lead, rmta_lag, delta_rmta)``; horizons are columns of one pass, then rows."""
    aggs = []
    for tau in horizons:
        aggs += [restricted_mean("t_lead", tau).alias(f"_a{tau}"), restricted_mean("t_lag", tau).alias(f"_b{tau}")]
    wide = runs.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(tau).alias("tau"), F.col(f"_a{tau}").alias("rmta_lead"), F.col(f"_b{tau}").alias("rmta_lag"))
        for tau in horizons])).alias("h")).select(*by, "h.*", (F.col("h.rmta_lag") - F.col("h.rmta_lead")).alias("delta_rmta"))


def fired_by(t: str, cycle: int) -> Column:
    """Aggregate: share of runs whose alarm came at or before ``cycle``."""
    return F.avg(F.when(F.col(t) <= cycle, 1.0).otherwise(0.0))


def lead_first() -> Column:
    """The leading detector fired before the lagging one, or alone."""
    a, b = F.col("t_lead"), F.col("t_lag")
    return a.isNotNull() & (b.isNull() | (a < b))


def any_fired() -> Column:
    return F.col("t_lead").isNotNull() | F.col("t_lag").isNotNull()


def win_probability(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Decided runs, wins and ties per group; ``p`` is NULL where nothing fired."""
    g = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_fired()).alias("n_decided"),
        F.count_if(lead_first()).alias("n_lead_first"), F.count_if(F.col("t_lead") == F.col("t_lag")).alias("n_ties"))
    return g.withColumn("p_lead_first", F.try_divide(F.col("n_lead_first"), F.col("n_decided")))


PATTERNS = ("both_fired", "lead_only", "lag_only", "neither")


def censoring_shares(runs: DataFrame, by: Sequence[str], x: str = "dt_censored") -> DataFrame:
    """Share of every firing pattern and its contribution to the mean; contributions add up to it."""
    pattern = firing_pattern("t_lead", "t_lag")
    n = F.count(F.lit(1))
    aggs: list[Column] = [n.alias("n"), F.avg(x).alias("mean")]
    for p in PATTERNS:
        aggs += [(F.count_if(pattern == p) / n).alias(f"frac_{p}"),
                 (F.coalesce(F.sum(F.when(pattern == p, F.col(x))), F.lit(0)) / n).alias(f"contribution_{p}")]
    return runs.groupBy(*by).agg(*aggs)
