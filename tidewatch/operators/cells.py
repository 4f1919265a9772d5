"""Group-level summaries of per-run rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.intervals import chi2_term


def collapse_copies(runs: DataFrame, group: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """One row per independent group: mean, any, all and majority of each flag over its copies, and its size."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("size")]
    for f in flags:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"{f}_mean"), F.bool_or(f).alias(f"{f}_any"),
                 F.bool_and(f).alias(f"{f}_all"), (F.avg(F.col(f).cast("double")) > 0.5).alias(f"{f}_majority")]
    return runs.groupBy(*group).agg(*aggs)


def strict_value(x: str) -> Column:
    """Aggregate: the one value all copies share; raises when they differ."""
    lo, hi = F.min(x), F.max(x)
    return F.when(lo == hi, lo).otherwise(
        F.raise_error(F.lit(f"copies of a group disagree on {x}")).cast("double"))


def heterogeneity(cells: DataFrame, by: Sequence[str], k: str = "k", n: str = "n") -> DataFrame:
    """Chi-square that one rate made every (k, n) cell of each ``by`` group; NULL for a pooled rate of 0 or 1.

    Two aggregations over the cell table, which is already down to one row per cell.
    """
    w = W.partitionBy(*by)
    p = F.try_divide(F.sum(k).over(w), F.sum(n).over(w))
    return (
        cells.withColumn("_p", p).groupBy(*by)
        .agg(F.sum(chi2_term(k, n, "_p")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"),
             F.max("_p").alias("pooled_rate"))
    )


def crossing(curve: DataFrame, by: Sequence[str], x: str, y: str, level: float = 0.0, out: str = "x_at_level") -> DataFrame:
    """First crossing of ``level`` along ascending ``x`` by linear interpolation; NULL when there is none.

    A curve has one row per design level.
    """
    w = W.partitionBy(*by).orderBy(x)
    a = F.col(y) - F.lit(level)
    nxt = curve.withColumns({"_a": a, "_b": F.lead(a).over(w), "_x2": F.lead(x).over(w)})
    crosses = (F.col("_a") <= 0) != (F.col("_b") <= 0)
    at = F.col(x) + (F.col("_x2") - F.col(x)) * F.try_divide(-F.col("_a"), F.col("_b") - F.col("_a"))
    return nxt.groupBy(*by).agg(F.min_by(F.when(crosses, at), F.when(crosses, F.col(x))).alias(out))
