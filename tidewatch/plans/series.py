"""Queries over per-cycle series: gap filling, rolling statistics, standardisation, alarms, run scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import rnd
from tidewatch.operators import alarms, recovery, rolling
from tidewatch.operators.alarms import LeadingRule, Rule
from tidewatch.plans.registry import query
from tidewatch.sources import tables as T

RUN = ["run", "scen"]
RULE = Rule()


# ------------------------------------------------------------------ SQL building blocks
def stats_sql(src: str, keys: Sequence[str], classes: Sequence[str], window: int, min_frac: float = 0.5,
              max_gap: int = 3, detrend: bool = True, p: str = "") -> str:
    """CTEs ending in ``{p}stats(keys, class, cycle, y, var, ac)`` from a dense wide series ``src``."""
    k = ", ".join(keys)
    need = max(4, -(-int(min_frac * window * 1000) // 1000))
    longs = " UNION ALL ".join(f"SELECT {k}, cycle, '{c}' AS class, {c} AS x FROM {src}" for c in classes)
    part = f"PARTITION BY {k}, class ORDER BY cycle"
    if detrend:
        va = "(aa - 2*beta*cat + beta*beta*ctt)"
        vb = "(bb - 2*beta*cbt + beta*beta*ctt)"
        cov = "(ab - beta*cat - beta*cbt + beta*beta*ctt)"
        var = "(syy - beta*sxy) / (k - 1)"
    else:
        va, vb, cov, var = "aa", "bb", "ab", "syy / (k - 1)"
    if max_gap == 0:
        return f"""
{p}long AS ({longs}),
{p}filled AS (SELECT *, x AS y FROM {p}long)""" + "," + rolling_sql(f"{p}filled", keys, window, need, va, vb, cov, var, p)
    return f"""
{p}long AS ({longs}),
{p}near AS (
  SELECT {k}, class, cycle, x,
    last_value(CASE WHEN x IS NOT NULL THEN cycle END IGNORE NULLS) OVER ({part} ROWS BETWEEN {max_gap} PRECEDING AND 1 PRECEDING) AS bc,
    last_value(x IGNORE NULLS) OVER ({part} ROWS BETWEEN {max_gap} PRECEDING AND 1 PRECEDING) AS bv,
    first_value(CASE WHEN x IS NOT NULL THEN cycle END IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {max_gap} FOLLOWING) AS ac,
    first_value(x IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {max_gap} FOLLOWING) AS av
  FROM {p}long),
{p}filled AS (
  SELECT {k}, class, cycle, x,
    CASE WHEN x IS NOT NULL THEN x WHEN ac - bc - 1 <= {max_gap} THEN bv + (av - bv) / (ac - bc) * (cycle - bc) END AS y
  FROM {p}near)""" + "," + rolling_sql(f"{p}filled", keys, window, need, va, vb, cov, var, p)


def rolling_sql(src: str, keys: Sequence[str], window: int, need: int, va: str, vb: str, cov: str, var: str,
                p: str = "", y: str = "y") -> str:
    k = ", ".join(keys)
    part = f"PARTITION BY {k}, class ORDER BY cycle"
    return f"""
{p}lagged AS (
  SELECT {k}, class, cycle, {y} AS b0, lag({y}) OVER ({part}) AS a0, CAST(cycle AS DOUBLE) AS t0, y FROM {src}),
{p}paired AS (
  SELECT *, CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN a0 END AS pa,
         CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN b0 END AS pb,
         CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN t0 END AS pt FROM {p}lagged),
{p}raw AS (
  SELECT {k}, class, cycle, y, count(b0) OVER f AS k, count(*) OVER f AS nrows, regr_slope(b0, t0) OVER f AS beta,
         regr_syy(b0, t0) OVER f AS syy, regr_sxy(b0, t0) OVER f AS sxy, count(pa) OVER g AS np,
         covar_pop(pa, pb) OVER g AS ab, var_pop(pa) OVER g AS aa, var_pop(pb) OVER g AS bb,
         covar_pop(pa, pt) OVER g AS cat, covar_pop(pb, pt) OVER g AS cbt, var_pop(pt) OVER g AS ctt
  FROM {p}paired
  WINDOW f AS ({part} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW),
         g AS ({part} ROWS BETWEEN {window - 2} PRECEDING AND CURRENT ROW)),
{p}stats AS (
  SELECT {k}, class, cycle, y,
    CASE WHEN nrows = {window} AND k >= {need} THEN greatest({var}, 0.0::DOUBLE) END AS var,
    CASE WHEN nrows = {window} AND k >= {need} AND np >= 4 AND {va} >= 1e-24 AND {vb} >= 1e-24
         THEN {cov} / sqrt({va} * {vb}) END AS ac
  FROM {p}raw)"""


def z_sql(stats: str, keys: Sequence[str], window: int, baseline_end: int, p: str = "") -> str:
    """CTEs ending in ``{p}z(keys, class, cycle, z_var, z_ac)``."""
    k = ", ".join(keys)
    leg = lambda x: (f"CASE WHEN b.n_{x} >= 8 THEN (s.{x} - b.m_{x}) / "  # noqa: E731
                     f"CASE WHEN b.s_{x} > 1e-9 THEN b.s_{x} ELSE 1e-9 END END AS z_{x}")
    on = " AND ".join(f"b.{c} = s.{c}" for c in [*keys, "class"])
    return f"""
{p}base AS (
  SELECT {k}, class, avg(var) AS m_var, stddev_samp(var) AS s_var, count(var) AS n_var,
         avg(ac) AS m_ac, stddev_samp(ac) AS s_ac, count(ac) AS n_ac
  FROM {stats} WHERE cycle >= {window - 1} AND cycle < {baseline_end} GROUP BY {k}, class),
{p}z AS (
  SELECT {", ".join("s." + c for c in keys)}, s.class, s.cycle, {leg("var")}, {leg("ac")}
  FROM {stats} s LEFT JOIN {p}base b ON {on})"""


COMBINE_SQL = {
    "mean": "0.5 * (z_var + z_ac)",
    "and": "CASE WHEN z_var IS NOT NULL AND z_ac IS NOT NULL THEN least(z_var, z_ac) END",
    "var_only": "z_var",
}


def score_sql(src: str, keys: Sequence[str], rule: LeadingRule, p: str = "") -> str:
    """CTEs ending in ``{p}scored(keys, cycle, z_var, z_ac, score)``."""
    k = ", ".join(keys)
    return (stats_sql(src, keys, rule.classes, rule.window, rule.min_frac, rule.max_gap, p=p) + ","
            + z_sql(f"{p}stats", keys, rule.window, rule.start, p) + f""",
{p}mixed AS (SELECT {k}, cycle, avg(z_var) AS z_var, avg(z_ac) AS z_ac FROM {p}z GROUP BY {k}, cycle),
{p}scored AS (SELECT *, {COMBINE_SQL[rule.combine]} AS score FROM {p}mixed)""")


def lead_sql(keys: Sequence[str], rule: LeadingRule, p: str = "") -> str:
    """CTEs ending in ``{p}lead`` with one row per run."""
    k = ", ".join(keys)
    w = f"OVER (PARTITION BY {k} ORDER BY cycle ROWS BETWEEN {rule.sustain - 1} PRECEDING AND CURRENT ROW)"
    ok = f"CASE WHEN cycle >= {rule.start} THEN score END"
    return f"""
{p}flagged AS (
  SELECT {k}, cycle, score,
    sum(CASE WHEN cycle >= {rule.start} AND score >= {rule.k} THEN 1 ELSE 0 END) {w} = {rule.sustain} AS hit,
    CASE WHEN count({ok}) {w} = {rule.sustain} THEN min({ok}) {w} END AS floor_score
  FROM {p}scored),
{p}lead AS (
  SELECT {k}, min(CASE WHEN hit THEN cycle END) AS t_lead, max({ok}) AS lead_max_score,
    max(floor_score) AS sustained_score,
    count(*) FILTER (WHERE cycle >= {rule.start} AND score IS NULL) AS score_null,
    count(*) FILTER (WHERE cycle >= {rule.start}) AS score_n
  FROM {p}flagged GROUP BY {k})"""


def lag_sql(src: str, keys: Sequence[str], output: str, rule: alarms.LaggingRule, p: str = "") -> str:
    """CTEs ending in ``{p}drops`` (per cycle) and ``{p}lag`` (per run)."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k} ORDER BY cycle"
    g = rule.max_gap
    return f"""
{p}lnear AS (
  SELECT {k}, cycle, {output} AS x,
    last_value(CASE WHEN {output} IS NOT NULL THEN cycle END IGNORE NULLS) OVER ({part} ROWS BETWEEN {g} PRECEDING AND 1 PRECEDING) AS bc,
    last_value({output} IGNORE NULLS) OVER ({part} ROWS BETWEEN {g} PRECEDING AND 1 PRECEDING) AS bv,
    first_value(CASE WHEN {output} IS NOT NULL THEN cycle END IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {g} FOLLOWING) AS ac,
    first_value({output} IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {g} FOLLOWING) AS av
  FROM {src}),
{p}lfilled AS (
  SELECT {k}, cycle,
    CASE WHEN x IS NOT NULL THEN x WHEN ac - bc - 1 <= {g} THEN bv + (av - bv) / (ac - bc) * (cycle - bc) END AS y
  FROM {p}lnear),
{p}lbase AS (
  SELECT {k}, count(y) AS base_n, avg(y) AS base_mean, stddev_samp(y) AS base_sd
  FROM {p}lfilled WHERE cycle < {rule.baseline_end} GROUP BY {k}),
{p}drops AS (
  SELECT {", ".join("f." + c for c in keys)}, f.cycle, f.y, base_mean, base_sd, base_n,
    CASE WHEN base_n >= 10 THEN (base_mean - f.y) / CASE WHEN base_sd > 1e-12 THEN base_sd ELSE 1e-12 END END AS drop_sd,
    coalesce(base_n >= 10 AND f.y < base_mean - {rule.k_sd} * base_sd, FALSE) AS below
  FROM {p}lfilled f LEFT JOIN {p}lbase USING ({k})),
{p}lhits AS (
  SELECT *, sum(CASE WHEN below AND cycle >= {rule.baseline_end} THEN 1 ELSE 0 END)
    OVER ({part} ROWS BETWEEN {rule.sustain - 1} PRECEDING AND CURRENT ROW) = {rule.sustain} AS hit
  FROM {p}drops),
{p}lag AS (
  SELECT {k}, min(CASE WHEN hit THEN cycle END) AS t_lag, max(base_mean) AS base_mean, max(base_sd) AS base_sd
  FROM {p}lhits GROUP BY {k})"""


def runs_sql(src: str, keys: Sequence[str], rule: Rule, n_cycles: int, output: str = "out", p: str = "") -> str:
    """CTEs ending in ``{p}scored_runs``: one row per run with alarms and lead times."""
    k = ", ".join(keys)
    return (score_sql(src, keys, rule.leading, p) + "," + lead_sql(keys, rule.leading, p) + ","
            + lag_sql(src, keys, output, rule.lagging, p) + f""",
{p}scored_runs AS (
  SELECT *, coalesce(t_lag, {n_cycles}) - coalesce(t_lead, {n_cycles}) AS dt_censored, t_lag - t_lead AS dt_paired,
    t_lead IS NOT NULL AS lead_fired, t_lag IS NOT NULL AS lag_fired
  FROM {p}lead LEFT JOIN (SELECT {k}, t_lag FROM {p}lag) USING ({k}))""")


SUP = T.supplier_series_sql()
STATS = f"WITH {SUP},{stats_sql('series', RUN, ('form', 'esc'), RULE.leading.window)}"
SCORED = f"WITH {SUP},{score_sql('series', RUN, RULE.leading)}"
RUNS = f"WITH {SUP},{runs_sql('series', RUN, RULE, T.SHIP_CYCLES)}"


def supplier_stats(spark: SparkSession, sf_dir: str, window: int = RULE.leading.window) -> DataFrame:
    return rolling.rolling_statistics(T.supplier_series(spark, sf_dir), RUN, ("form", "esc"), window)


def supplier_scores(spark: SparkSession, sf_dir: str, rule: LeadingRule = RULE.leading) -> DataFrame:
    return alarms.score_series(T.supplier_series(spark, sf_dir), RUN, rule)


def supplier_runs(spark: SparkSession, sf_dir: str, rule: Rule = RULE) -> DataFrame:
    return alarms.score_runs(T.supplier_series(spark, sf_dir), RUN, rule, T.SHIP_CYCLES)


# ------------------------------------------------------------------ queries
@query("cycle_series", f"""WITH {T.EVENT_HOURS_SQL}
SELECT event_type, cycle, round(y, 6) AS mean_value, coalesce(n, 0) AS n, cycle < 90 AS in_baseline FROM event_hours""")
def cycle_series(spark, sf_dir):
    """Hourly mean and count of an event measure on a complete cycle axis; empty hours have a NULL mean."""
    return T.event_hours(spark, sf_dir).select(
        "event_type", F.col("cycle").cast("bigint"), rnd("y").alias("mean_value"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.col("cycle") < 90).alias("in_baseline"))


@query("reporting_mean", f"""WITH {T.EVENT_HOURS_SQL}
SELECT event_type, cycle, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n,
  round(CASE WHEN sum(coalesce(n, 0)) OVER w > 0 THEN sum(s) OVER w / sum(coalesce(n, 0)) OVER w END, 7) AS mean_value
FROM event_hours WINDOW w AS (PARTITION BY event_type ORDER BY cycle ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def reporting_mean(spark, sf_dir):
    """Published output: pooled mean of the events of the trailing ten cycles."""
    out = rolling.pooled_trailing_mean(T.event_hours(spark, sf_dir), ["event_type"], "s", "n", 10, "m")
    return out.select("event_type", F.col("cycle").cast("bigint"), F.col("m_n").alias("n"), rnd("m", 7).alias("mean_value"))


@query("gap_fill", STATS + " SELECT run, scen, class, cycle, round(x, 6) AS x, round(y, 6) AS y FROM filled")
def gap_fill(spark, sf_dir):
    """Linear interpolation of interior gaps of up to three cycles."""
    long = rolling.unpivot_classes(T.supplier_series(spark, sf_dir), RUN, ("form", "esc"))
    return rolling.fill_gaps(long, [*RUN, "class"]).select(*RUN, "class", "cycle", rnd("x").alias("x"), rnd("y").alias("y"))


@query("rolling_variance_autocorrelation",
       STATS + " SELECT run, scen, class, cycle, round(var, 6) AS var, round(ac, 6) AS ac FROM stats")
def rolling_variance_autocorrelation(spark, sf_dir):
    """Variance and lag-1 autocorrelation of the detrended trailing window of every series."""
    return supplier_stats(spark, sf_dir).select(*RUN, "class", "cycle", rnd("var").alias("var"), rnd("ac").alias("ac"))


@query("baseline_z", f"WITH {SUP},{stats_sql('series', RUN, ('form', 'esc'), 20)},{z_sql('stats', RUN, 20, 60)}"
       " SELECT run, scen, class, cycle, round(z_var, 6) AS z_var, round(z_ac, 6) AS z_ac FROM z")
def baseline_z(spark, sf_dir):
    """Rolling statistics standardised against each series' own reference period."""
    z = rolling.baseline_z(supplier_stats(spark, sf_dir), RUN, 20, 60)
    return z.select(*RUN, "class", "cycle", rnd("z_var").alias("z_var"), rnd("z_ac").alias("z_ac"))


@query("twin_baseline", f"""WITH {SUP},{stats_sql('series', RUN, ('form', 'esc'), 20)},
base AS (SELECT run, class, avg(var) AS m_var, stddev_samp(var) AS s_var, count(var) AS n_var,
   avg(ac) AS m_ac, stddev_samp(ac) AS s_ac, count(ac) AS n_ac
   FROM stats WHERE scen = 'control' AND cycle >= 19 AND cycle < 60 GROUP BY 1, 2)
SELECT s.run, s.class, s.cycle,
  round(CASE WHEN n_var >= 8 THEN (var - m_var) / CASE WHEN s_var > 1e-9 THEN s_var ELSE 1e-9 END END, 6) AS z_var,
  round(CASE WHEN n_ac >= 8 THEN (ac - m_ac) / CASE WHEN s_ac > 1e-9 THEN s_ac ELSE 1e-9 END END, 6) AS z_ac
FROM stats s LEFT JOIN base b ON b.run = s.run AND b.class = s.class WHERE s.scen = 'degrade'""")
def twin_baseline(spark, sf_dir):
    """The same standardisation with the reference taken from the matched control series."""
    stats = supplier_stats(spark, sf_dir)
    z = rolling.twin_baseline_z(stats.where("scen = 'degrade'").drop("scen"), stats.where("scen = 'control'").drop("scen"),
                                ["run"], 20, 60)
    return z.select("run", "class", "cycle", rnd("z_var").alias("z_var"), rnd("z_ac").alias("z_ac"))


@query("sustained_alarm", SCORED + f",{lead_sql(RUN, RULE.leading)}"
       " SELECT run, scen, t_lead, round(lead_max_score, 6) AS lead_max_score, round(sustained_score, 6) AS sustained_score FROM lead")
def sustained_alarm(spark, sf_dir):
    """Leading alarm per run with its maximum score and the sufficient statistic of the level rule."""
    return alarms.leading_alarm(supplier_scores(spark, sf_dir), RUN, RULE.leading).select(
        *RUN, "t_lead", rnd("lead_max_score").alias("lead_max_score"), rnd("sustained_score").alias("sustained_score"))


@query("lagging_alarm", f"WITH {SUP},{lag_sql('series', RUN, 'out', RULE.lagging)}"
       " SELECT run, scen, t_lag, round(base_mean, 6) AS base_mean, round(base_sd, 6) AS base_sd FROM lag")
def lagging_alarm(spark, sf_dir):
    """Alarm on a sustained drop of the published output below its reference."""
    out = alarms.lagging_alarm(T.supplier_series(spark, sf_dir), RUN, "out", RULE.lagging)
    return out.select(*RUN, "t_lag", rnd("base_mean").alias("base_mean"), rnd("base_sd").alias("base_sd"))


@query("score_runs", RUNS + """
SELECT run, scen, t_lead, t_lag, dt_censored, dt_paired, lead_fired, lag_fired, round(lead_max_score, 6) AS lead_max_score
FROM scored_runs""")
def score_runs(spark, sf_dir):
    """Events to alarms to lead times for every run in one job."""
    return supplier_runs(spark, sf_dir).select(
        *RUN, "t_lead", "t_lag", "dt_censored", "dt_paired", "lead_fired", "lag_fired",
        rnd("lead_max_score").alias("lead_max_score"))


@query("run_detail", RUNS + """
SELECT run, scen, t_lead, round(sustained_score, 6) AS sustained_score, score_null, score_n,
  round(1.0 * score_null / score_n, 6) AS null_fraction FROM scored_runs""")
def run_detail(spark, sf_dir):
    """Per-run detail with the number of scored cycles whose score is undefined."""
    return supplier_runs(spark, sf_dir).select(
        *RUN, "t_lead", rnd("sustained_score").alias("sustained_score"), "score_null", "score_n",
        rnd(F.col("score_null") / F.col("score_n")).alias("null_fraction"))


@query("score_combinations", SCORED + "," + ",".join(f"""
s_{h} AS (SELECT run, scen, '{h}' AS combine, cycle, {COMBINE_SQL[h]} AS score FROM mixed)""" for h in COMBINE_SQL) + """
SELECT run, scen, combine, count(score) AS n_scored, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score
FROM (SELECT * FROM s_mean UNION ALL SELECT * FROM s_and UNION ALL SELECT * FROM s_var_only) GROUP BY 1, 2, 3""")
def score_combinations(spark, sf_dir):
    """The three ways of combining the variance and autocorrelation legs."""
    from tidewatch.functions.columns import combine_legs
    z = supplier_scores(spark, sf_dir)
    wide = z.select(*RUN, *[combine_legs(F.col("z_var"), F.col("z_ac"), h).alias(h) for h in COMBINE_SQL])
    return (wide.unpivot(RUN, list(COMBINE_SQL), "combine", "score").groupBy(*RUN, "combine")
            .agg(F.count("score").alias("n_scored"), rnd(F.max("score")).alias("max_score"),
                 rnd(F.avg("score")).alias("mean_score")))


@query("trailing_mean", SCORED + """
SELECT run, scen, cycle, round(CASE WHEN count(score) OVER w >= 6 THEN avg(score) OVER w END, 6) AS smooth
FROM scored WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def trailing_mean(spark, sf_dir):
    """Published form of an indicator: trailing mean, partial windows allowed."""
    return rolling.trailing_mean(supplier_scores(spark, sf_dir), RUN, "score", 20, "m").select(
        *RUN, "cycle", rnd("m").alias("smooth"))


KERNEL = f"""WITH {SUP},{stats_sql('series', RUN, ('form',), 20, p='a_')},
r AS (
  SELECT a.run, a.scen, a.class, a.cycle, any_value(a.y) - sum(exp(-0.5 * power((b.cycle - a.cycle) / 10.0, 2)) * b.y)
      / sum(exp(-0.5 * power((b.cycle - a.cycle) / 10.0, 2))) AS y
  FROM a_filled a JOIN a_filled b ON a.run = b.run AND a.scen = b.scen AND a.class = b.class AND b.y IS NOT NULL
  WHERE a.y IS NOT NULL GROUP BY 1, 2, 3, 4),
known AS (SELECT run, scen, class, count(y) AS n FROM a_filled GROUP BY 1, 2, 3),
residual AS (
  SELECT f.run, f.scen, f.class, f.cycle, CASE WHEN k.n >= 5 THEN r.y END AS y
  FROM a_filled f LEFT JOIN r USING (run, scen, class, cycle) LEFT JOIN known k USING (run, scen, class))"""


def kernel_residuals(spark, sf_dir, classes=("form",)):
    long = rolling.unpivot_classes(T.supplier_series(spark, sf_dir), RUN, classes)
    return rolling.kernel_residual(rolling.fill_gaps(long, [*RUN, "class"]), [*RUN, "class"])


@query("kernel_residual", KERNEL + " SELECT run, scen, cycle, round(y, 6) AS residual FROM residual")
def kernel_residual(spark, sf_dir):
    """Residual from a Gaussian-kernel mean of the whole gap-filled series."""
    return kernel_residuals(spark, sf_dir).select(*RUN, "cycle", rnd("r").alias("residual"))


KERNEL_STATS = KERNEL + "," + rolling_sql("residual", RUN, 20, 10, "aa", "bb", "ab", "syy / (k - 1)")


@query("kernel_rolling", KERNEL_STATS + " SELECT run, scen, cycle, round(var, 6) AS var, round(ac, 6) AS ac FROM stats")
def kernel_rolling(spark, sf_dir):
    """Rolling variance and autocorrelation of the kernel residual, centred but not detrended again."""
    out = rolling.kernel_statistics(T.supplier_series(spark, sf_dir), RUN, ("form",), 20)
    return out.select(*RUN, "cycle", rnd("var").alias("var"), rnd("ac").alias("ac"))


@query("kendall_tau", f"""WITH {SUP},
p AS (SELECT a.run, a.scen, sum(sign(b.form - a.form)) AS s, sum(CASE WHEN a.form = b.form THEN 1 ELSE 0 END) AS tied
      FROM series a JOIN series b ON a.run = b.run AND a.scen = b.scen AND a.cycle < b.cycle GROUP BY 1, 2),
n AS (SELECT run, scen, count(form) AS n FROM series GROUP BY 1, 2)
SELECT run, scen, n.n, round(CASE WHEN n.n >= 4 AND n.n * (n.n - 1) / 2 > tied THEN
   s / sqrt((n.n * (n.n - 1) / 2 - tied) * (n.n * (n.n - 1) / 2)) END, 6) AS tau
FROM n LEFT JOIN p USING (run, scen)""")
def kendall_tau(spark, sf_dir):
    """Tau-b of each series against time."""
    out = rolling.kendall_tau(T.supplier_series(spark, sf_dir), RUN, "form")
    return out.select(*RUN, "n", rnd("tau").alias("tau"))


def tau_sql(span: int, need: int) -> str:
    pairs = "(n * (n - 1) / 2)"
    return f"""
tau_in AS (SELECT run, scen, class, cycle, unnest(['var', 'ac']) AS leg, unnest([round(var, 9), round(ac, 9)]) AS x FROM stats),
tau_pair AS (
  SELECT e.run, e.scen, e.class, e.leg, e.cycle, sum(sign(b.x - a.x)) AS s, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tied
  FROM (SELECT DISTINCT run, scen, class, leg, cycle FROM tau_in WHERE cycle >= {span - 1}) e
  JOIN tau_in a ON a.run = e.run AND a.scen = e.scen AND a.class = e.class AND a.leg = e.leg
    AND a.cycle > e.cycle - {span} AND a.cycle <= e.cycle AND a.x IS NOT NULL
  JOIN tau_in b ON b.run = e.run AND b.scen = e.scen AND b.class = e.class AND b.leg = e.leg
    AND b.cycle > a.cycle AND b.cycle <= e.cycle AND b.x IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5),
tau_n AS (
  SELECT run, scen, class, leg, cycle, count(x) OVER w AS n, count(*) OVER w AS nrows FROM tau_in
  WINDOW w AS (PARTITION BY run, scen, class, leg ORDER BY cycle ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)),
tau AS (
  SELECT n.run, n.scen, n.class, n.leg, n.cycle, CASE WHEN nrows = {span} AND n >= {need} AND {pairs} > tied THEN
     s / sqrt(({pairs} - tied) * {pairs}) END AS tau
  FROM tau_n n LEFT JOIN tau_pair USING (run, scen, class, leg, cycle)),
trends AS (
  SELECT run, scen, cycle, avg(tau) FILTER (WHERE leg = 'var') AS tau_var, avg(tau) FILTER (WHERE leg = 'ac') AS tau_ac
  FROM tau GROUP BY 1, 2, 3)"""


def class_trends(spark, sf_dir, window=20, span=15):
    stats = supplier_stats(spark, sf_dir, window)
    # ties are judged at nine decimals: the last bits of a double depend on the order of addition
    judged = stats.withColumns({leg: rnd(leg, 9) for leg in ("var", "ac")})
    return rolling.rolling_tau(judged, [*RUN, "class"], ["var", "ac"], span, ["tau_var", "tau_ac"])


def mixed_trends(spark, sf_dir, window=20, span=15):
    return class_trends(spark, sf_dir, window, span).groupBy(*RUN, "cycle").agg(
        F.avg("tau_var").alias("tau_var"), F.avg("tau_ac").alias("tau_ac"))


@query("rolling_tau", STATS + "," + tau_sql(15, 9) + """
SELECT run, scen, class, cycle, round(max(tau) FILTER (WHERE leg = 'var'), 6) AS tau_var,
  round(max(tau) FILTER (WHERE leg = 'ac'), 6) AS tau_ac FROM tau GROUP BY 1, 2, 3, 4""")
def rolling_tau(spark, sf_dir):
    """Kendall tau of the trailing values of each rolling statistic."""
    return class_trends(spark, sf_dir).select(*RUN, "class", "cycle", rnd("tau_var").alias("tau_var"), rnd("tau_ac").alias("tau_ac"))


TREND = f"""
hits AS (
  SELECT *, sum(CASE WHEN cycle >= 40 AND tau_var >= 0.3 AND tau_ac >= 0.3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS hit
  FROM trends)"""


@query("trend_alarm", STATS + "," + tau_sql(15, 9) + "," + TREND + """
SELECT run, scen, min(CASE WHEN hit THEN cycle END) AS alarm_cycle,
  round(max(CASE WHEN cycle >= 40 AND tau_var IS NOT NULL AND tau_ac IS NOT NULL THEN least(tau_var, tau_ac) END), 6) AS max_score
FROM hits GROUP BY 1, 2""")
def trend_alarm(spark, sf_dir):
    """Alarm when the class-mean trends of both statistics stay above a threshold."""
    t = mixed_trends(spark, sf_dir)
    both = (F.col("tau_var") >= 0.3) & (F.col("tau_ac") >= 0.3)
    hit = alarms.sustained(t, RUN, both, 3, 40, "hit")
    known = (F.col("cycle") >= 40) & F.col("tau_var").isNotNull() & F.col("tau_ac").isNotNull()
    return hit.groupBy(*RUN).agg(alarms.first_cycle("hit").alias("alarm_cycle"),
                                 rnd(F.max(F.when(known, F.least("tau_var", "tau_ac")))).alias("max_score"))
