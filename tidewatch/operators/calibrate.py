"""Thresholds picked on null data to a target false-alarm rate.

Everything works on the sufficient statistic of a run, the largest level it holds for the sustained time, so one
pass over the series serves the whole grid of thresholds and the grid never multiplies the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators import rolling
from tidewatch.operators.alarms import LaggingRule


def grid_values(start: float, stop: float, step: float) -> list[float]:
    return [round(start + step * i, 3) for i in range(int(round((stop - start) / step)) + 1)]


def _grid(grid: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(k)) for k in grid])


def _reached(x: Column, grid: Sequence[float], strict: bool = False) -> Column:
    """How many of the ascending thresholds ``x`` reaches; 0 for NULL."""
    test = (lambda k: x > k) if strict else (lambda k: x >= k)
    return F.when(x.isNotNull(), F.size(F.filter(_grid(grid), test))).otherwise(F.lit(0))


def fpr_curve(stats: DataFrame, by: Sequence[str], x: str, grid: Sequence[float]) -> DataFrame:
    """Rows ``(by…, k, n, n_false, fpr)`` for every threshold.

    Runs are counted by the highest threshold they reach; only those counts, at most one per threshold and group,
    are spread over the grid.
    """
    by = list(by)
    counts = stats.groupBy(*by, _reached(F.col(x), grid).alias("_top")).agg(F.count(F.lit(1)).alias("_c"))
    spread = counts.select(*by, "_c", "_top", F.posexplode(_grid(grid)).alias("_pos", "k"))
    return spread.groupBy(*by, "k").agg(
        F.sum("_c").alias("n"), F.sum(F.when(F.col("_top") > F.col("_pos"), F.col("_c")).otherwise(0)).alias("n_false")
    ).withColumn("fpr", F.col("n_false") / F.col("n"))


def smallest_admissible(curve: DataFrame, by: Sequence[str], target: float, required: bool = True) -> DataFrame:
    """Per group the smallest threshold with a rate at or below ``target``.

    A group without one is an error where a threshold is ``required``; a search over many groups leaves it out.
    """
    ok = F.col("fpr") <= target
    none = F.raise_error(F.lit(f"no threshold of the grid reaches the target {target}")).cast("double")
    if not required:
        curve, none = curve.where(ok), F.lit(None).cast("double")
    return curve.groupBy(*by).agg(
        F.coalesce(F.min(F.when(ok, F.col("k"))), none).alias("k"),
        F.min_by(F.when(ok, F.col("fpr")), F.when(ok, F.col("k"))).alias("fpr"),
        F.min_by(F.when(ok, F.col("n_false")), F.when(ok, F.col("k"))).alias("n_false"), F.max("n").alias("n"))


def count_matched(curve: DataFrame, by: Sequence[str], target_count: Column | int) -> DataFrame:
    """Per group the threshold whose false-alarm count is nearest the target; of equals the larger."""
    target = target_count if isinstance(target_count, Column) else F.lit(target_count)
    best = F.struct((-F.abs(F.col("n_false") - target)).alias("near"), F.col("k"))
    return curve.groupBy(*by).agg(F.max_by(F.struct("k", "n_false", "fpr"), best).alias("b")).select(*by, "b.*")


def alarm_by_threshold(floors: DataFrame, keys: Sequence[str], x: str, grid: Sequence[float], strict: bool = False) -> DataFrame:
    """Alarm cycle of every run at every threshold it reaches: rows ``(keys…, k, alarm_cycle)``.

    Only cycles that set a new record of ``x`` can be first at some threshold; each record emits the thresholds
    between the old record and itself.
    """
    order = W.partitionBy(*keys).orderBy("cycle").rowsBetween(W.unboundedPreceding, -1)
    ranked = floors.withColumns({
        "_now": _reached(F.col(x), grid, strict), "_before": _reached(F.max(x).over(order), grid, strict)})
    records = ranked.where(F.col("_now") > F.col("_before"))
    ks = F.slice(_grid(grid), F.col("_before") + 1, F.col("_now") - F.col("_before"))
    return records.select(*keys, F.explode(ks).alias("k"), F.col("cycle").alias("alarm_cycle"))


LEVELS = "array<struct<top: double, most: double, reached: array<int>>>"


def held_levels(cycle: np.ndarray, x: np.ndarray, sustain: int, start: int, grid: Sequence[float], strict: bool = False) -> list[tuple]:
    """For each series of a matrix the largest level held for ``sustain`` cycles from ``start`` on, the largest value there, and the
    cycles at which it first holds each of the ascending thresholds, as many as it reaches."""
    usable = np.where(cycle >= start, x, np.nan)
    floor = np.full(x.shape, -np.inf)
    if x.shape[1] >= sustain:
        frames = [usable[:, j:x.shape[1] - sustain + 1 + j] for j in range(sustain)]
        held = frames[0]
        for f in frames[1:]:
            held = np.minimum(held, f)  # NaN if one is
        floor[:, sustain - 1:] = np.where(np.isnan(held), -np.inf, held)
    best = np.maximum.accumulate(floor, axis=1)
    first = np.stack([((best <= k) if strict else (best < k)).sum(axis=1) for k in grid], axis=1)
    most = np.where(np.isnan(usable), -np.inf, usable).max(axis=1)
    finite = lambda v: float(v) if v > -np.inf else None
    return [(finite(top), finite(m), cycle[at[at < len(cycle)]].tolist()) for top, m, at in zip(best[:, -1], most, first)]


def _levels(arrays: DataFrame, keys: Sequence[str], values: dict[str, str], variants: Sequence[dict], work) -> DataFrame:
    """Rows ``(variant…, keys…, top, most, reached)``; ``work`` gives :func:`held_levels` of every variant in their order."""
    @F.pandas_udf(LEVELS)
    def levels(rows: pd.DataFrame) -> pd.Series:
        def of_stack(cycle, *xs):
            per_series = zip(*work(cycle, *xs))
            return {"levels": [[dict(zip(("top", "most", "reached"), v)) for v in one] for one in per_series]}
        return rolling.by_axis(rows, ["levels"], of_stack)["levels"]

    named = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in v.items()]) for v in variants])
    each = arrays.select(*keys, F.explode(F.arrays_zip(named.alias("v"), levels(rolling.array_columns(values)).alias("l"))).alias("_z"))
    return each.select("_z.v.*", *keys, "_z.l.*")


def leading_levels(series: DataFrame, keys: Sequence[str], windows: Sequence[int], class_sets: dict[str, Sequence[str]], combines: Sequence[str],
                   sustains: Sequence[int], start: int, grid: Sequence[float], min_frac: float = 0.5, max_gap: int = 3) -> DataFrame:
    """Every variant of the leading rule on every run: rows ``(window, classes, combine, sustain, keys…, top, most, reached)``, see
    :func:`held_levels`. A run's series stay the arrays of one row, so the variants never multiply its cycles."""
    classes = list(dict.fromkeys(c for cls in class_sets.values() for c in cls))
    combined = {"mean": lambda v, a: 0.5 * (v + a), "and": np.minimum, "var_only": lambda v, a: v}
    variants = [{"window": w, "classes": name, "combine": h, "sustain": s} for w in windows for name in class_sets for h in combines for s in sustains]

    def work(cycle, *xs):
        ys, out = [rolling.filled(cycle, x, max_gap) for x in xs], []
        for w in windows:
            legs = dict(zip(classes, rolling.mixed_legs(cycle, ys, w, min_frac, start)))
            for cls in class_sets.values():
                v, a = (rolling.mean_known([legs[c][i] for c in cls]) for i in (0, 1))
                out += [held_levels(cycle, combined[h](v, a), s, start, grid) for h in combines for s in sustains]
        return out

    return _levels(rolling.series_arrays(series, keys, classes), keys, {f"x{i}": c for i, c in enumerate(classes)}, variants, work)


def lagging_levels(series: DataFrame, keys: Sequence[str], output: str, rule: LaggingRule, sustains: Sequence[int], grid: Sequence[float],
                   min_baseline: int = 10) -> DataFrame:
    """The same for the drop of :func:`alarms.output_drop`, strictly above each threshold: rows ``(sustain, keys…, top, most, reached)``."""
    def work(cycle, x):
        y = rolling.filled(cycle, x, rule.max_gap)
        ref = y[:, cycle < rule.baseline_end]
        known = ~np.isnan(ref)
        n = known.sum(axis=1, keepdims=True)
        mean = np.where(known, ref, 0.0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
        d = np.where(known, ref - mean, 0.0)
        sd = np.sqrt((d * d).sum(axis=1, keepdims=True) / np.maximum(n - 1, 1))
        drop = np.where(n >= min_baseline, (mean - y) / np.where(sd > 1e-12, sd, 1e-12), np.nan)
        return [held_levels(cycle, drop, s, rule.baseline_end, grid, strict=True) for s in sustains]

    return _levels(rolling.series_arrays(series, keys, [output]), keys, {"x0": output}, [{"sustain": s} for s in sustains], work)
