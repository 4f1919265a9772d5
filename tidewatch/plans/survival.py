"""Queries on alarm times: restricted means, incidence, win probability, censoring, floors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import rnd
from tidewatch.functions.intervals import rate, wilson, wilson_sql
from tidewatch.operators import survival as S
from tidewatch.operators.cells import crossing
from tidewatch.plans.registry import query
from tidewatch.sources.runs import user_runs, user_runs_sql

RUNS = f"WITH {user_runs_sql()}"
HORIZONS = (60, 120, 180, 240, 300, 360)
FOLD = 200


def degrade(spark, sf_dir):
    return user_runs(spark, sf_dir).where("scen = 'degrade'")


@query("detection_probability", RUNS + f"""
SELECT c, arm, colour, count(*) AS n, count(t_lead) AS lead_fired, count(t_lag) AS lag_fired,
  round({wilson_sql('count(t_lead)', 'count(*)', -1)}, 9) AS lead_lo95, round({wilson_sql('count(t_lead)', 'count(*)', 1)}, 9) AS lead_hi95,
  median(t_lead) AS lead_median, median(t_lag) AS lag_median,
  round(avg(CASE WHEN t_lead < {FOLD} THEN 1.0::DOUBLE ELSE 0 END), 9) AS lead_before_fold,
  round(avg(CASE WHEN t_lag < {FOLD} THEN 1.0::DOUBLE ELSE 0 END), 9) AS lag_before_fold
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3""")
def detection_probability(spark, sf_dir):
    """Detection rates with Wilson intervals, median alarm and the share before the transition cycle."""
    return degrade(spark, sf_dir).groupBy("c", "arm", "colour").agg(
        F.count(F.lit(1)).alias("n"), F.count("t_lead").alias("lead_fired"), F.count("t_lag").alias("lag_fired"),
        F.median("t_lead").alias("lead_median"), F.median("t_lag").alias("lag_median"),
        rnd(S.fired_by("t_lead", FOLD - 1), 9).alias("lead_before_fold"), rnd(S.fired_by("t_lag", FOLD - 1), 9).alias("lag_before_fold"),
    ).withColumns({"lead_lo95": rnd(wilson("lead_fired", "n", -1), 9), "lead_hi95": rnd(wilson("lead_fired", "n", 1), 9)})


RMTA = " UNION ALL ".join(f"""SELECT c, arm, colour, {t} AS tau, avg(least(coalesce(t_lead, 360), {t})) AS a, avg(least(coalesce(t_lag, 360), {t})) AS b
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3""" for t in HORIZONS)


@query("restricted_mean_time", RUNS + f""", r AS ({RMTA})
SELECT c, arm, colour, tau, round(a, 9) AS rmta_lead, round(b, 9) AS rmta_lag, round(b - a, 9) AS delta_rmta FROM r""")
def restricted_mean_time(spark, sf_dir):
    """Restricted mean time to alarm of both detectors at several horizons."""
    r = S.restricted_means(degrade(spark, sf_dir), ["c", "arm", "colour"], HORIZONS)
    return r.select("c", "arm", "colour", "tau", *[rnd(x, 9).alias(x) for x in ("rmta_lead", "rmta_lag", "delta_rmta")])


@query("restricted_mean_identity", RUNS + """,
m AS (SELECT c, arm, colour, avg(coalesce(t_lag, 360)) - avg(coalesce(t_lead, 360)) AS d, avg(dt_censored) AS m FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3)
SELECT count(*) AS n_cells, count(*) FILTER (WHERE abs(d - m) > 1e-9) AS n_violations FROM m""")
def restricted_mean_identity(spark, sf_dir):
    """With one censoring time the mean censored lead equals the restricted-mean difference at the run length."""
    g = degrade(spark, sf_dir).groupBy("c", "arm", "colour").agg(
        (S.restricted_mean("t_lag", 360) - S.restricted_mean("t_lead", 360)).alias("d"), F.avg("dt_censored").alias("m"))
    return g.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.abs(F.col("d") - F.col("m")) > 1e-9).alias("n_violations"))


INC = (50, 100, 150, 200, 250, 300, 350)


@query("cumulative_incidence", RUNS + f""", g AS (SELECT unnest({list(INC)}) AS cycle)
SELECT c, arm, cycle, round(avg(CASE WHEN t_lead <= cycle THEN 1.0::DOUBLE ELSE 0 END), 9) AS lead, round(avg(CASE WHEN t_lag <= cycle THEN 1.0::DOUBLE ELSE 0 END), 9) AS lag
FROM runs CROSS JOIN g WHERE scen = 'degrade' GROUP BY 1, 2, 3""")
def cumulative_incidence(spark, sf_dir):
    """Share of runs alarmed by declared cycles: one pass, then columns to rows."""
    aggs = []
    for t in INC:
        aggs += [S.fired_by("t_lead", t).alias(f"_a{t}"), S.fired_by("t_lag", t).alias(f"_b{t}")]
    wide = degrade(spark, sf_dir).groupBy("c", "arm").agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("cycle"), rnd(f"_a{t}", 9).alias("lead"), rnd(f"_b{t}", 9).alias("lag")) for t in INC]))
    return wide.select("c", "arm", rows.alias("r")).select("c", "arm", "r.*")


@query("win_probability", RUNS + f"""
SELECT c, arm, colour, count(*) AS n, count(*) FILTER (WHERE lead_fired OR lag_fired) AS n_decided,
  count(*) FILTER (WHERE lead_fired AND (NOT lag_fired OR t_lead < t_lag)) AS n_lead_first, count(*) FILTER (WHERE t_lead = t_lag) AS n_ties,
  round(CASE WHEN count(*) FILTER (WHERE lead_fired OR lag_fired) > 0 THEN 1.0 * count(*) FILTER (WHERE lead_fired AND (NOT lag_fired OR t_lead < t_lag)) / count(*) FILTER (WHERE lead_fired OR lag_fired) END, 9) AS p_lead_first
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3""")
def win_probability(spark, sf_dir):
    """Probability that the leading detector comes first, given that any fired."""
    w = S.win_probability(degrade(spark, sf_dir), ["c", "arm", "colour"])
    return w.withColumn("p_lead_first", rnd("p_lead_first", 9))


PAT = {"both_fired": "lead_fired AND lag_fired", "lead_only": "lead_fired AND NOT lag_fired",
       "lag_only": "lag_fired AND NOT lead_fired", "neither": "NOT lead_fired AND NOT lag_fired"}
PAT_SQL = ", ".join(f"round(count(*) FILTER (WHERE {w}) / count(*), 9) AS frac_{p}, "
                    f"round(coalesce(sum(dt_censored) FILTER (WHERE {w}), 0) / count(*), 9) AS contribution_{p}" for p, w in PAT.items())


@query("censoring_accounting", RUNS + f"""
SELECT c, arm, colour, count(*) AS n, round(avg(dt_censored), 9) AS dt_mean, {PAT_SQL},
  abs((coalesce(sum(dt_censored) FILTER (WHERE {PAT['both_fired']}), 0) + coalesce(sum(dt_censored) FILTER (WHERE {PAT['lead_only']}), 0)
   + coalesce(sum(dt_censored) FILTER (WHERE {PAT['lag_only']}), 0) + coalesce(sum(dt_censored) FILTER (WHERE {PAT['neither']}), 0)) / count(*) - avg(dt_censored)) < 1e-9 AS adds_up
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3""")
def censoring_accounting(spark, sf_dir):
    """How much of a mean censored lead rests on each firing pattern."""
    s = S.censoring_shares(degrade(spark, sf_dir), ["c", "arm", "colour"])
    total = sum((F.col(f"contribution_{p}") for p in S.PATTERNS), F.lit(0.0))
    parts = [rnd(f"{kind}_{p}", 9).alias(f"{kind}_{p}") for p in S.PATTERNS for kind in ("frac", "contribution")]
    return s.select("c", "arm", "colour", "n", rnd("mean", 9).alias("dt_mean"), *parts, (F.abs(total - F.col("mean")) < 1e-9).alias("adds_up"))


ESTIMATORS = f"""
est AS (
  SELECT arm, colour, c, avg(dt_censored) AS censored, avg(dt_paired) AS paired,
    avg(least(coalesce(t_lag, 360), 180)) - avg(least(coalesce(t_lead, 360), 180)) AS tau180,
    CASE WHEN count(*) FILTER (WHERE lead_fired OR lag_fired) > 0 THEN 1.0 * count(*) FILTER (WHERE lead_fired AND (NOT lag_fired OR t_lead < t_lag)) / count(*) FILTER (WHERE lead_fired OR lag_fired) END - 0.5 AS win,
    avg(lead_fired::INT) - 0.4 AS detect
  FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3),
curve AS (
  SELECT arm, colour, c, estimator, a, lead(a) OVER w AS b, lead(c) OVER w AS c2
  FROM (SELECT arm, colour, c, unnest(['censored', 'paired', 'tau180', 'win', 'detect']) AS estimator, unnest([censored, paired, tau180, win, detect]) AS a FROM est)
  WINDOW w AS (PARTITION BY arm, colour, estimator ORDER BY c))"""


@query("floor_crossings", RUNS + "," + ESTIMATORS + """
SELECT arm, colour, estimator, round(arg_min(c + (c2 - c) * (-a) / (b - a), c) FILTER (WHERE (a <= 0) <> (b <= 0)), 9) AS c_at_level
FROM curve GROUP BY 1, 2, 3""")
def floor_crossings(spark, sf_dir):
    """Coverage at which each estimator of the lead crosses its level, by linear interpolation."""
    est = degrade(spark, sf_dir).groupBy("arm", "colour", "c").agg(
        F.avg("dt_censored").alias("censored"), F.avg("dt_paired").alias("paired"),
        (S.restricted_mean("t_lag", 180) - S.restricted_mean("t_lead", 180)).alias("tau180"),
        (F.try_divide(F.count_if(S.lead_first()), F.count_if(S.any_fired())) - 0.5).alias("win"),
        (rate("lead_fired") - 0.4).alias("detect"))
    long = est.unpivot(["arm", "colour", "c"], ["censored", "paired", "tau180", "win", "detect"], "estimator", "y")
    x = crossing(long, ["arm", "colour", "estimator"], "c", "y", out="c_at_level")
    return x.withColumn("c_at_level", rnd("c_at_level", 9))


@query("confusion_over_time", RUNS + """,
t AS (SELECT arm, cycle, avg(CASE WHEN scen = 'degrade' THEN CASE WHEN t_lead <= cycle THEN 0.0::DOUBLE ELSE 1 END END) AS fn,
        avg(CASE WHEN scen = 'control' THEN CASE WHEN t_lead <= cycle THEN 1.0::DOUBLE ELSE 0 END END) AS fp
      FROM runs CROSS JOIN (SELECT range AS cycle FROM range(360)) GROUP BY 1, 2)
SELECT arm, CAST(cycle AS INTEGER) AS cycle, round(fn, 9) AS fn, round(fp, 9) AS fp, round(sum(fn + fp) OVER (PARTITION BY arm ORDER BY cycle), 6) AS cost FROM t""")
def confusion_over_time(spark, sf_dir):
    """Missed and false alarms at every cycle and their running cost.

    Runs are counted per alarm cycle first; the curve is a running sum over the cycle axis, not runs times cycles.
    """
    runs = user_runs(spark, sf_dir)
    deg, ctl = F.col("scen") == "degrade", F.col("scen") == "control"
    fired = runs.groupBy("arm", F.col("t_lead").alias("cycle")).agg(F.count_if(deg).alias("d"), F.count_if(ctl).alias("k"))
    totals = runs.groupBy("arm").agg(F.count_if(deg).alias("nd"), F.count_if(ctl).alias("nk"))
    axis = totals.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(359))))
    w = W.partitionBy("arm").orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    seen = axis.join(fired, ["arm", "cycle"], "left").withColumns({
        "fn": 1 - F.try_divide(F.coalesce(F.sum("d").over(w), F.lit(0)), F.col("nd")),
        "fp": F.try_divide(F.coalesce(F.sum("k").over(w), F.lit(0)), F.col("nk"))})
    return seen.select("arm", "cycle", rnd("fn", 9).alias("fn"), rnd("fp", 9).alias("fp"),
                       rnd(F.sum(F.col("fn") + F.col("fp")).over(w), 6).alias("cost"))


@query("alarm_order_curve", RUNS + """,
cells AS (SELECT arm, c, avg(dt_censored) AS dt, avg(lead_fired::INT) AS det, count(*) AS n FROM runs WHERE scen = 'degrade' GROUP BY 1, 2)
SELECT arm, list(round(c, 6) ORDER BY c) AS cs, list(round(dt, 9) ORDER BY c) AS dts, list(round(det, 9) ORDER BY c) AS detect, list(n ORDER BY c) AS ns FROM cells GROUP BY 1""")
def alarm_order_curve(spark, sf_dir):
    """Variant curves as arrays ordered by coverage."""
    c = degrade(spark, sf_dir).groupBy("arm", "c").agg(
        F.avg("dt_censored").alias("dt"), rate("lead_fired").alias("det"), F.count(F.lit(1)).alias("n"))
    pts = F.array_sort(F.collect_list(F.struct(rnd("c").alias("c"), rnd("dt", 9).alias("dt"), rnd("det", 9).alias("det"), "n")))
    p = c.groupBy("arm").agg(pts.alias("p"))
    return p.select("arm", F.col("p.c").alias("cs"), F.col("p.dt").alias("dts"), F.col("p.det").alias("detect"), F.col("p.n").alias("ns"))
