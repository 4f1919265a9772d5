"""Sustained alarms on scored series and the scalars they reduce a run to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import combine_legs
from tidewatch.operators.rolling import baseline_z, class_scores, fill_gaps, mix_classes, rolling_statistics


@dataclass(frozen=True)
class LeadingRule:
    """Declared parameters of the leading (score level) rule."""

    window: int = 20
    classes: tuple[str, ...] = ("form", "esc")
    k: float = 1.5
    sustain: int = 3
    start: int = 60
    combine: str = "mean"
    min_frac: float = 0.5
    max_gap: int = 3


@dataclass(frozen=True)
class LaggingRule:
    """Declared parameters of the lagging (output drop) rule."""

    baseline_end: int = 60
    k_sd: float = 1.0
    sustain: int = 2
    max_gap: int = 3


@dataclass(frozen=True)
class Rule:
    leading: LeadingRule = LeadingRule()
    lagging: LaggingRule = LaggingRule()

    def with_leading(self, **changes) -> "Rule":
        return replace(self, leading=replace(self.leading, **changes))

    def with_lagging(self, **changes) -> "Rule":
        return replace(self, lagging=replace(self.lagging, **changes))


def score_series(series: DataFrame, keys: Sequence[str], rule: LeadingRule, block: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys, cycle, z_var, z_ac, score)`` of the leading rule, with the columns of ``series`` named in ``carry``."""
    if block is None:
        z = class_scores(series, keys, rule.classes, rule.window, rule.min_frac, rule.max_gap, rule.start, carry)
    else:
        stats = rolling_statistics(series, keys, rule.classes, rule.window, rule.min_frac, rule.max_gap, block=block)
        z = mix_classes(baseline_z(stats, keys, rule.window, rule.start), keys)
        if carry:
            z = z.join(series.select(*keys, "cycle", *carry), [*keys, "cycle"])
    return z.withColumn("score", combine_legs(F.col("z_var"), F.col("z_ac"), rule.combine))


def sustained(df: DataFrame, keys: Sequence[str], hit: Column, sustain: int, start: int, out: str) -> DataFrame:
    """Flag the rows that end ``sustain`` consecutive hits, all at or after ``start``; NULL is no hit."""
    frame = W.partitionBy(*keys).orderBy("cycle").rowsBetween(1 - sustain, 0)
    counted = F.when(hit & (F.col("cycle") >= start), 1).otherwise(0)
    return df.withColumn(out, F.sum(counted).over(frame) == sustain)


def sustained_floor(df: DataFrame, keys: Sequence[str], x: Column, sustain: int, start: int, out: str) -> DataFrame:
    """Add the smallest of the last ``sustain`` values where all are known and at or after ``start``.

    Its maximum per run is the sufficient statistic of the level rule: the rule with threshold k fires iff it is
    at least k, so one pass serves every threshold.
    """
    frame = W.partitionBy(*keys).orderBy("cycle").rowsBetween(1 - sustain, 0)
    usable = F.when(F.col("cycle") >= start, x)
    full = F.count(usable).over(frame) == sustain
    return df.withColumn(out, F.when(full, F.min(usable).over(frame)))


def first_cycle(flag: Column | str) -> Column:
    """Aggregate: earliest cycle where ``flag`` holds, NULL if it never does."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.min(F.when(flag, F.col("cycle")))


def leading_alarm(scored: DataFrame, keys: Sequence[str], rule: LeadingRule) -> DataFrame:
    """One row per run: ``t_lead``, ``lead_max_score``, ``sustained_score``, ``score_null``, ``score_n``."""
    s = F.col("score")
    flagged = sustained(scored, keys, s >= rule.k, rule.sustain, rule.start, "_hit")
    flagged = sustained_floor(flagged, keys, s, rule.sustain, rule.start, "_floor")
    after = F.col("cycle") >= rule.start
    return flagged.groupBy(*keys).agg(
        first_cycle("_hit").alias("t_lead"),
        F.max(F.when(after, s)).alias("lead_max_score"),
        F.max("_floor").alias("sustained_score"),
        F.count_if(after & s.isNull()).alias("score_null"),
        F.count_if(after).alias("score_n"),
    )


def output_drop(series: DataFrame, keys: Sequence[str], output: str, rule: LaggingRule,
                min_baseline: int = 10) -> DataFrame:
    """Gap-filled output with its drop below the reference mean, in reference standard deviations.

    ``drop`` is NULL for a run with fewer than ``min_baseline`` known reference values; ``below`` adds the raw
    comparison ``value < mean - k_sd * sd`` of the declared rule.
    """
    filled = fill_gaps(series.select(*keys, "cycle", F.col(output).alias("x")), keys, max_gap=rule.max_gap)
    whole = W.partitionBy(*keys)
    ref = F.when(F.col("cycle") < rule.baseline_end, F.col("y"))
    out = filled.withColumns({
        "base_n": F.count(ref).over(whole), "base_mean": F.avg(ref).over(whole),
        "base_sd": F.stddev_samp(ref).over(whole),
    })
    enough = F.col("base_n") >= min_baseline
    sd = F.when(F.col("base_sd") > 1e-12, F.col("base_sd")).otherwise(F.lit(1e-12))
    return out.withColumns({
        "drop": F.when(enough, (F.col("base_mean") - F.col("y")) / sd),
        "below": enough & (F.col("y") < F.col("base_mean") - rule.k_sd * F.col("base_sd")),
    })


def lagging_alarm(series: DataFrame, keys: Sequence[str], output: str, rule: LaggingRule) -> DataFrame:
    """One row per run: ``t_lag`` and the reference it was judged by."""
    d = sustained(output_drop(series, keys, output, rule), keys, F.col("below"), rule.sustain, rule.baseline_end,
                  "_hit")
    return d.groupBy(*keys).agg(
        first_cycle("_hit").alias("t_lag"), F.max("base_mean").alias("base_mean"), F.max("base_sd").alias("base_sd"))


def lead_columns(n_cycles: int) -> dict[str, Column]:
    """Derived per-run scalars from ``t_lead`` and ``t_lag``."""
    a, b, h = F.col("t_lead"), F.col("t_lag"), F.lit(n_cycles)
    return {
        "dt_censored": F.coalesce(b, h) - F.coalesce(a, h),
        "dt_paired": b - a,
        "lead_fired": a.isNotNull(),
        "lag_fired": b.isNotNull(),
    }


def score_runs(series: DataFrame, keys: Sequence[str], rule: Rule, n_cycles: int, output: str = "out") -> DataFrame:
    """Every run of ``series`` reduced to its alarms and lead times, all runs in one job.

    Leading and lagging side share the hash partitioning on ``keys``; the final join adds no exchange of raw rows.
    """
    lead = leading_alarm(score_series(series, keys, rule.leading), keys, rule.leading)
    lag = lagging_alarm(series, keys, output, rule.lagging).select(*keys, "t_lag")
    return lead.join(lag, list(keys), "left").withColumns(lead_columns(n_cycles))
