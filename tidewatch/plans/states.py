"""Queries on tails, recovery, segments, end states and comparator gain."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import relative_swing, rnd
from tidewatch.functions.intervals import rate
from tidewatch.operators import alarms, recovery, rolling
from tidewatch.plans import series as P
from tidewatch.plans.inference import rank_corr_sql
from tidewatch.plans.registry import query
from tidewatch.plans.series import RULE, RUN, SCORED, SUP
from tidewatch.sources import tables as T
from tidewatch.sources.tables import SHIP_CYCLES, supplier_series

N = SHIP_CYCLES
FILLED = f"WITH {SUP},{P.stats_sql('series', RUN, ('out',), 20)}"


def filled_output(spark, sf_dir):
    long = rolling.unpivot_classes(supplier_series(spark, sf_dir), RUN, ("out",))
    return rolling.fill_gaps(long, [*RUN, "class"]).select(*RUN, "cycle", "y")


@query("recovery_fit", FILLED + f""",
lv AS (SELECT run, scen, avg(y) FILTER (WHERE cycle >= 75 AND cycle < 100) AS zs, avg(y) FILTER (WHERE cycle >= {N - 30}) AS ze FROM filled GROUP BY 1, 2),
pt AS (SELECT run, scen, CASE WHEN abs(zs - y) > 1e-3 THEN ln(abs(zs - y)) END AS ly, CAST(cycle - 100 AS DOUBLE) AS t FROM filled JOIN lv USING (run, scen) WHERE cycle >= 100 AND cycle < 160),
ft AS (SELECT run, scen, count(ly) AS n_points, CASE WHEN count(ly) >= 8 THEN -regr_slope(ly, t) END AS r, CASE WHEN count(ly) >= 8 AND regr_syy(ly, t) > 1e-12 THEN regr_r2(ly, t) END AS r2 FROM pt GROUP BY 1, 2)
SELECT run, scen, n_points, round(zs, 6) AS z_star, round(ze, 6) AS z_end, round(r, 8) AS recovery_rate, round(r2, 8) AS fit_r2, ze > 0.6 * zs AS returned FROM lv LEFT JOIN ft USING (run, scen)""")
def recovery_fit(spark, sf_dir):
    """Return to the level before a declared cycle: rate, fit and whether the run came back."""
    r = recovery.recovery_fit(filled_output(spark, sf_dir), RUN, "y", 100, N)
    return r.select(*RUN, "n_points", rnd("z_star").alias("z_star"), rnd("z_end").alias("z_end"), rnd("recovery_rate", 8).alias("recovery_rate"),
                    rnd("fit_r2", 8).alias("fit_r2"), "returned")


@query("tail_state", FILLED + f""",
l AS (SELECT run, scen, cycle, y, lag(y) OVER (PARTITION BY run, scen ORDER BY cycle) AS p FROM filled WHERE cycle >= {N - 60})
SELECT run, scen, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS sd,
  round(CASE WHEN count(CASE WHEN p IS NOT NULL THEN y END) > 3 AND stddev_pop(y) > 1e-12 THEN corr(p, y) END, 8) AS ac1 FROM l GROUP BY 1, 2""")
def tail_state(spark, sf_dir):
    """Equilibrium statistics of the last sixty cycles."""
    return recovery.tail_state(filled_output(spark, sf_dir), RUN, "y", N).select(
        *RUN, rnd("mean").alias("mean"), rnd("sd").alias("sd"), rnd("ac1", 8).alias("ac1"))


CHECKPOINTS = (80, 120, 160, 179)


@query("checkpoint_means", FILLED + " SELECT run, scen, " + ", ".join(
    f"round(avg(y) FILTER (WHERE cycle >= {c - 60} AND cycle < {c}), 6) AS tail_{c}" for c in CHECKPOINTS) + " FROM filled GROUP BY 1, 2")
def checkpoint_means(spark, sf_dir):
    """Tail means at several horizons from one grouping."""
    return filled_output(spark, sf_dir).groupBy(*RUN).agg(*[
        rnd(recovery.window_mean("y", c - 60, c)).alias(f"tail_{c}") for c in CHECKPOINTS])


GAIN = f"""WITH {SUP},{P.lag_sql('series', RUN, 'out', RULE.lagging)},
fl AS (SELECT run, scen, cycle, drop_sd, CASE WHEN count(CASE WHEN cycle >= 60 THEN drop_sd END) OVER w = 2 THEN min(CASE WHEN cycle >= 60 THEN drop_sd END) OVER w END AS f
  FROM drops WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
gain AS (SELECT run, scen, max(drop_sd) FILTER (WHERE cycle >= 60) AS drop_max, max(f) AS drop_sustained FROM fl GROUP BY 1, 2)"""


def gain_rows(spark, sf_dir):
    g = RULE.lagging
    d = alarms.output_drop(supplier_series(spark, sf_dir), RUN, "out", g)
    d = alarms.sustained_floor(d, RUN, F.col("drop"), g.sustain, g.baseline_end, "f")
    return d.groupBy(*RUN).agg(F.max(F.when(F.col("cycle") >= g.baseline_end, F.col("drop"))).alias("drop_max"), F.max("f").alias("drop_sustained"))


@query("comparator_gain", GAIN + " SELECT run, scen, round(drop_max, 6) AS drop_max, round(drop_sustained, 6) AS drop_sustained FROM gain")
def comparator_gain(spark, sf_dir):
    """Largest and largest sustained output drop in reference standard deviations."""
    return gain_rows(spark, sf_dir).select(*RUN, rnd("drop_max").alias("drop_max"), rnd("drop_sustained").alias("drop_sustained"))


@query("gain_table", GAIN + f"""
SELECT scen AS variant, count(*) AS n_runs, round(avg(drop_sustained), 6) AS gain, round(stddev_samp(drop_sustained) / sqrt(count(drop_sustained)), 6) AS gain_se,
  round(avg(drop_max), 6) AS gain_max, avg(drop_sustained) >= {RULE.lagging.k_sd} AS can_fire, round(avg(drop_max) / avg(drop_sustained), 6) AS sensitivity_ratio FROM gain GROUP BY 1""")
def gain_table(spark, sf_dir):
    """Pooled comparator gain per variant and whether it reaches the rule's threshold."""
    m = F.avg("drop_sustained")
    return gain_rows(spark, sf_dir).groupBy(F.col("scen").alias("variant")).agg(
        F.count(F.lit(1)).alias("n_runs"), rnd(m).alias("gain"), rnd(F.stddev_samp("drop_sustained") / F.sqrt(F.count("drop_sustained"))).alias("gain_se"),
        rnd(F.avg("drop_max")).alias("gain_max"), (m >= RULE.lagging.k_sd).alias("can_fire"), rnd(F.avg("drop_max") / m).alias("sensitivity_ratio"))


@query("windowed_means", f"""WITH {SUP}
SELECT run, scen, round(avg(out) FILTER (WHERE cycle >= 40 AND cycle < 60), 6) AS out_early, round(avg(out) FILTER (WHERE cycle >= {N - 30}), 6) AS out_late,
  round(avg(form) FILTER (WHERE cycle >= 40 AND cycle < 60), 6) AS form_early, round(avg(form) FILTER (WHERE cycle >= {N - 30}), 6) AS form_late,
  round(avg(CASE WHEN form >= 25 THEN 1.0::DOUBLE WHEN form IS NOT NULL THEN 0 END), 9) AS frac_at_or_above_knee, round(max(form), 6) AS form_max FROM series GROUP BY 1, 2""")
def windowed_means(spark, sf_dir):
    """Means in declared windows and the share of cycles at or above a knee."""
    m = recovery.window_mean
    return supplier_series(spark, sf_dir).groupBy(*RUN).agg(
        rnd(m("out", 40, 60)).alias("out_early"), rnd(m("out", N - 30, N)).alias("out_late"), rnd(m("form", 40, 60)).alias("form_early"),
        rnd(m("form", N - 30, N)).alias("form_late"), rnd(rate(F.col("form") >= 25), 9).alias("frac_at_or_above_knee"), rnd(F.max("form")).alias("form_max"))


@query("amplitude_audit", f"""WITH {SUP},
m AS (SELECT scen, avg(out) FILTER (WHERE cycle >= 40 AND cycle < 60) AS oa, avg(out) FILTER (WHERE cycle >= {N - 30}) AS ob,
  avg(form) FILTER (WHERE cycle >= 40 AND cycle < 60) AS fa, avg(form) FILTER (WHERE cycle >= {N - 30}) AS fb FROM series GROUP BY 1)
SELECT scen, round((oa - ob) / oa, 9) AS out_swing, round((fa - fb) / fa, 9) AS form_swing, round(oa / fa, 9) AS ratio_of_means FROM m""")
def amplitude_audit(spark, sf_dir):
    """Relative swings of leading and lagging measures between two windows."""
    m = recovery.window_mean
    a = supplier_series(spark, sf_dir).groupBy("scen").agg(m("out", 40, 60).alias("oa"), m("out", N - 30, N).alias("ob"),
                                                           m("form", 40, 60).alias("fa"), m("form", N - 30, N).alias("fb"))
    return a.select("scen", rnd(relative_swing("oa", "ob"), 9).alias("out_swing"), rnd(relative_swing("fa", "fb"), 9).alias("form_swing"),
                    rnd(F.try_divide("oa", "fa"), 9).alias("ratio_of_means"))


LATENT = SCORED + f""",
lat0 AS (SELECT run, scen, cycle, out, avg(out) OVER (PARTITION BY run, scen) AS om, CASE WHEN count(out) OVER w >= 6 THEN avg(out) OVER w END AS tm FROM series
  WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
lat AS (SELECT s.run, s.scen, s.cycle, s.score, tm / om AS a FROM scored s JOIN lat0 USING (run, scen, cycle)),
st AS (SELECT run, scen, greatest(100, coalesce(min(CASE WHEN a <= 0.9 THEN cycle END), {N})) AS stop FROM lat GROUP BY 1, 2),
seg AS (SELECT l.run, l.scen, l.cycle, l.score, l.a FROM lat l JOIN st USING (run, scen) WHERE l.cycle >= 60 AND l.cycle < stop),
sm AS (SELECT run, scen, concat_ws('|', run, scen) AS rk_key, round(CASE WHEN count(score) OVER w >= 6 THEN avg(score) OVER w END, 9) AS xs, round(a, 9) AS ya FROM seg
  WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),{rank_corr_sql('sm', 'run, scen', 'xs', 'ya')}"""


@query("indicator_vs_latent", LATENT + """
SELECT run, scen, CAST(stop AS INTEGER) AS stop, n AS n_points, round(CASE WHEN n >= 20 THEN rho END, 8) AS rho FROM st LEFT JOIN rho USING (run, scen)""")
def indicator_vs_latent(spark, sf_dir):
    """Does the published indicator follow the latent driver up to its threshold crossing?"""
    series = supplier_series(spark, sf_dir)
    driver = rolling.trailing_mean(series, RUN, "out", 20, "tm").withColumn("a", F.try_divide("tm", F.avg("out").over(W.partitionBy(*RUN))))
    joined = alarms.score_series(driver, RUN, RULE.leading, carry=("a",))
    r = recovery.indicator_vs_latent(joined, RUN, "score", "a", 60, N, 0.9)
    return r.select(*RUN, "stop", F.col("n").alias("n_points"), rnd("rho", 8).alias("rho"))


@query("indicator_legs", LATENT + f""",
sv AS (SELECT s.run, s.scen, s.cycle, s.z_var, l.a FROM scored s JOIN lat l USING (run, scen, cycle) JOIN st USING (run, scen) WHERE s.cycle >= 60 AND s.cycle < stop),
sw AS (SELECT run, scen, round(CASE WHEN count(z_var) OVER w >= 6 THEN avg(z_var) OVER w END, 9) AS xs, round(a, 9) AS ya FROM sv
  WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),{rank_corr_sql('sw', 'run, scen', 'xs', 'ya').replace('rk AS', 'rkv AS').replace('FROM rk', 'FROM rkv').replace('rho AS (', 'rhov AS (')},
plain AS (SELECT run, scen, count(*) AS n, CASE WHEN count(*) >= 20 AND stddev_pop(score) > 1e-12 AND stddev_pop(a) > 1e-12 THEN corr(score, a) END AS r FROM seg
  WHERE score IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2)
SELECT st.run, st.scen, coalesce(plain.n, 0) AS n_raw, round(r, 8) AS pearson_raw, round(CASE WHEN rho.n >= 20 THEN rho.rho END, 8) AS mean_leg,
  round(CASE WHEN rhov.n >= 20 THEN rhov.rho END, 8) AS var_leg FROM st LEFT JOIN plain USING (run, scen) LEFT JOIN rho USING (run, scen) LEFT JOIN rhov USING (run, scen)""")
def indicator_legs(spark, sf_dir):
    """The published score against the driver as it is and by ranks, and its variance leg by ranks."""
    series = supplier_series(spark, sf_dir)
    driver = rolling.trailing_mean(series, RUN, "out", 20, "tm").withColumn("a", F.try_divide("tm", F.avg("out").over(W.partitionBy(*RUN))))
    joined = alarms.score_series(driver, RUN, RULE.leading, carry=("a",))
    r = recovery.indicator_legs(joined, RUN, {"mean_leg": "score", "var_leg": "z_var"}, "a", 60, N, 0.9)
    return r.select(*RUN, "n_raw", *[rnd(x, 8).alias(x) for x in ("pearson_raw", "mean_leg", "var_leg")])


@query("largest_gap", """
WITH v AS (SELECT DISTINCT c_mktsegment, c_acctbal AS x FROM customer), g AS (SELECT c_mktsegment, x, x - lag(x) OVER (PARTITION BY c_mktsegment ORDER BY x) AS gap FROM v)
SELECT c_mktsegment, round(max(gap), 6) AS largest_gap, round(max(gap) / (max(x) - min(x)), 9) AS relative_gap FROM g GROUP BY 1""")
def largest_gap(spark, sf_dir):
    """Widest gap in the pooled end-state distribution."""
    g = recovery.largest_gap(T.table(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return g.select("c_mktsegment", rnd("largest_gap").alias("largest_gap"), rnd(F.try_divide("largest_gap", "range"), 9).alias("relative_gap"))


END = """
e AS (SELECT l_linestatus AS n, l_linenumber * 1.0::DOUBLE AS a, l_suppkey AS rep, avg(l_quantity) AS z FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT n, avg(z) FILTER (WHERE a = 1) AS hi, avg(z) FILTER (WHERE a = 7) AS lo FROM e GROUP BY 1)"""


@query("mid_band_occupancy", f"""WITH {END}
SELECT n, a, count(*) AS n_seeds, round(avg(CASE WHEN abs(z - 0.5 * (hi + lo)) < 0.20 * greatest(1e-9, abs(hi - lo)) THEN 1.0::DOUBLE ELSE 0 END), 9) AS occupancy FROM e JOIN r USING (n) GROUP BY 1, 2""")
def mid_band_occupancy(spark, sf_dir):
    """Share of end states in the middle band between the reference levels."""
    e = T.table(spark, sf_dir, "lineitem", "l_linestatus", "l_linenumber", "l_suppkey", "l_quantity").groupBy(
        F.col("l_linestatus").alias("n"), F.col("l_linenumber").cast("double").alias("a"), F.col("l_suppkey").alias("rep")).agg(F.avg("l_quantity").alias("z"))
    r = e.groupBy("n").agg(F.avg(F.when(F.col("a") == 1, F.col("z"))).alias("hi"), F.avg(F.when(F.col("a") == 7, F.col("z"))).alias("lo"))
    inside = F.abs(F.col("z") - 0.5 * (F.col("hi") + F.col("lo"))) < 0.20 * F.greatest(F.lit(1e-9), F.abs(F.col("hi") - F.col("lo")))
    return e.join(r, "n").groupBy("n", "a").agg(F.count(F.lit(1)).alias("n_seeds"), rnd(rate(inside), 9).alias("occupancy"))


@query("branch_table", """
WITH b AS (SELECT l_linestatus AS n, l_linenumber * 1.0::DOUBLE AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS up, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS lo,
    stddev_pop(l_quantity) FILTER (WHERE l_returnflag = 'A') AS sd FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, up - lead(up) OVER w AS dr, lead(a) OVER w AS na, greatest(1e-9, first_value(up) OVER w2 - last_value(up) OVER w2) AS rng, last_value(up) OVER w2 AS zlo FROM b
  WINDOW w AS (PARTITION BY n ORDER BY a DESC), w2 AS (PARTITION BY n ORDER BY a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, (up - zlo) / rng AS frac FROM c)
SELECT n, round(max(dr), 6) AS jump, round(max(dr) / any_value(rng), 6) AS jump_relative, 0.5::DOUBLE * (arg_max(a, dr) + arg_max(na, dr)) AS fold_midpoint,
  coalesce(max(a) FILTER (WHERE frac > 0.15 AND frac < 0.85) - min(a) FILTER (WHERE frac > 0.15 AND frac < 0.85), 0.0::DOUBLE) AS transition_width,
  count(*) FILTER (WHERE up - lo > 0.1) AS n_bistable, coalesce(max(a) FILTER (WHERE up - lo > 0.1) - min(a) FILTER (WHERE up - lo > 0.1), 0.0::DOUBLE) AS bistable_width,
  round(max(up - lo), 6) AS max_gap, arg_min(a, abs(frac - 0.5)) AS a_mid, arg_max(a, sd) AS peak_sd_at FROM d GROUP BY 1""")
def branch_table(spark, sf_dir):
    """Two branches along a design axis: jump, fold, transition width, bistable window, peak spread."""
    li = T.table(spark, sf_dir, "lineitem", "l_linestatus", "l_linenumber", "l_returnflag", "l_quantity")
    on = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))
    cells = li.groupBy(F.col("l_linestatus").alias("n"), F.col("l_linenumber").cast("double").alias("a")).agg(
        F.avg(on("A")).alias("upper"), F.avg(on("R")).alias("lower"), F.stddev_pop(on("A")).alias("sd"))
    b = recovery.branch_summary(cells, "n", 0.1)
    return b.select("n", rnd("jump").alias("jump"), rnd("jump_relative").alias("jump_relative"), "fold_midpoint", "transition_width", "n_bistable",
                    "bistable_width", rnd("max_gap").alias("max_gap"), "a_mid", "peak_sd_at")


@query("scenario_table", P.RUNS + f""",
h AS (SELECT run, scen, avg(out) FILTER (WHERE cycle >= {N - 30}) < 0.95 * avg(out) FILTER (WHERE cycle < 30) AS collapsed, min(out) AS omin FROM series GROUP BY 1, 2)
SELECT scen, count(*) AS n_runs, round(avg(collapsed::INT), 9) AS collapsed_frac, round(avg(omin), 6) AS mean_min, round(avg(lead_fired::INT), 9) AS lead_rate, round(avg(lag_fired::INT), 9) AS lag_rate,
  round(avg(dt_censored), 9) AS dt_mean, median(t_lead) AS median_t_lead FROM scored_runs JOIN h USING (run, scen) GROUP BY 1""")
def scenario_table(spark, sf_dir):
    """Alarm rates per scenario next to how many of its runs really collapsed."""
    s = supplier_series(spark, sf_dir)
    late, early = recovery.window_mean("out", N - 30, N), recovery.window_mean("out", 0, 30)
    h = s.groupBy(*RUN).agg((late < 0.95 * early).alias("collapsed"), F.min("out").alias("omin"))
    r = alarms.score_runs(s, RUN, RULE, N).join(h, RUN)
    return r.groupBy("scen").agg(
        F.count(F.lit(1)).alias("n_runs"), rnd(rate("collapsed"), 9).alias("collapsed_frac"), rnd(F.avg("omin")).alias("mean_min"), rnd(rate("lead_fired"), 9).alias("lead_rate"),
        rnd(rate("lag_fired"), 9).alias("lag_rate"), rnd(F.avg("dt_censored"), 9).alias("dt_mean"), F.median("t_lead").alias("median_t_lead"))
