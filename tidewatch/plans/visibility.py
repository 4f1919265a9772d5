"""Queries on visibility: masks, dual streams, retroactive rewrites, propensity correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.columns import rnd
from tidewatch.operators import alarms
from tidewatch.operators import visibility as V
from tidewatch.operators.alarms import LeadingRule
from tidewatch.plans import series as P
from tidewatch.plans.graph import centrality_z
from tidewatch.plans.registry import query
from tidewatch.sources import tables as T
from tidewatch.sources import teams as M
from tidewatch.sources.tables import ORDER_DAYS, densify, unit_hash_sql
from tidewatch.sources.teams import EVENTS_SQL, MEMBERS_SQL

# Coverage before and after the revocation, its cycle, and the weekly cycle axis of the team log.
BEFORE, AFTER, T_REV = 0.8, 0.5, 200
WEEKS = 344
WEEK = 7
U = unit_hash_sql("supplier", "node")


@query("mcar_mask", f"SELECT s_suppkey AS node, {U} < 0.5 AS visible FROM (SELECT s_suppkey, s_suppkey AS node FROM supplier)")
def mcar_mask(spark, sf_dir):
    """Mask that hides nodes completely at random."""
    return M.nodes(spark, sf_dir).select("node", V.mcar("node", 0.5).alias("visible"))


Z_SQL = f"""{MEMBERS_SQL},
t AS (SELECT team, count(*) AS m FROM members GROUP BY 1), d AS (SELECT node, sum(m - 1) AS deg FROM members JOIN t USING (team) GROUP BY 1),
f AS (SELECT s_suppkey AS node, coalesce(deg, 0) AS deg FROM supplier LEFT JOIN d ON d.node = s_suppkey),
z AS (SELECT node, deg, (deg - (SELECT avg(deg) FROM f)) / (SELECT CASE WHEN stddev_pop(deg) > 1e-9 THEN stddev_pop(deg) ELSE 1 END FROM f) AS z FROM f)"""
BISECT = f"""WITH RECURSIVE {Z_SQL},
b AS (SELECT 0 AS step, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi UNION ALL
  SELECT step + 1, CASE WHEN (SELECT avg(1 / (1 + exp(-(1.5 * z + (lo + hi) / 2)))) FROM z) < 0.5 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN (SELECT avg(1 / (1 + exp(-(1.5 * z + (lo + hi) / 2)))) FROM z) < 0.5 THEN hi ELSE (lo + hi) / 2 END FROM b WHERE step < 80),
a0 AS (SELECT (lo + hi) / 2 AS a FROM b WHERE step = 80)"""


@query("mnar_mask", BISECT + f" SELECT node, round(1 / (1 + exp(-(1.5 * z + a))), 8) AS p, {U} < 1 / (1 + exp(-(1.5 * z + a))) AS visible FROM z, a0")
def mnar_mask(spark, sf_dir):
    """Mask in which better connected nodes are more visible, its mean bisected to the coverage."""
    z = centrality_z(spark, sf_dir)
    return V.mnar(z, 1.5, 0.5, "supplier", levels="deg").select("node", rnd("p", 8).alias("p"), "visible")


@query("revocation_sample", f"""WITH {Z_SQL}
SELECT node FROM z WHERE {U} < 0.8 ORDER BY -ln(greatest({unit_hash_sql('revoke', 'node')}, power(2.0, -33))) * (1 + exp(-0.8 * z)), node LIMIT 20""")
def revocation_sample(spark, sf_dir):
    """Twenty visible nodes drawn without replacement, the central ones more likely."""
    z = centrality_z(spark, sf_dir).where(V.mcar("node", BEFORE))
    return V.weighted_sample(z, "node", C.logistic(V.REVOCATION_SLOPE * F.col("z")), 20, "revoke").select("node")


# ------------------------------------------------------------------ team log as two observers see it
LOG_SQL = f"""{MEMBERS_SQL},{EVENTS_SQL},
tl AS (SELECT team, count(*) AS m, count(*) FILTER (WHERE {U} < {BEFORE}) AS kp, count(*) FILTER (WHERE {U} < {AFTER}) AS kr FROM members GROUP BY 1),
log AS (SELECT level, CAST(cycle // {WEEK} AS INTEGER) AS cycle, team, m, kp, kr, value,
   CASE WHEN kp >= 2 THEN value * CASE WHEN kp >= m OR m <= 1 THEN 1.0 ELSE (kp / (kp + 1.0)) / (m / (m + 1.0)) END END AS vp,
   CASE WHEN kr >= 2 THEN value * CASE WHEN kr >= m OR m <= 1 THEN 1.0 ELSE (kr / (kr + 1.0)) / (m / (m + 1.0)) END END AS vr
 FROM tl JOIN team_events USING (team))"""


def team_log(spark, sf_dir):
    """Rows ``(level, cycle, team, m, kp, kr, value, vp, vr)``: each team as seen before and after the revocation.

    The later mask is a subset of the earlier one, the same draw below a lower coverage.
    """
    sizes = M.members(spark, sf_dir).groupBy("team").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(V.mcar("node", BEFORE)).alias("kp"), F.count_if(V.mcar("node", AFTER)).alias("kr"))
    log = sizes.join(M.team_events(spark, sf_dir), "team").withColumn("cycle", F.floor(F.col("cycle") / WEEK).cast("int"))
    return log.withColumns({f"v{s}": V.recorded_value(F.col("value"), F.col(f"k{s}"), F.col("m")) for s in ("p", "r")}).select(
        "level", "cycle", "team", "m", "kp", "kr", "value", "vp", "vr")


@query("recorded_values", f"WITH {LOG_SQL}" + """
SELECT team, m, kp, round(vp, 6) AS recorded, round(greatest(0.001, 1 - power(0.2, m) - m * 0.8 * power(0.2, m - 1)), 9) AS p_observed FROM log""")
def recorded_values(spark, sf_dir):
    """What partial observation records of every team, and the chance of recording it."""
    return team_log(spark, sf_dir).select("team", "m", "kp", rnd("vp").alias("recorded"), rnd(C.p_observed("m", 0.8), 9).alias("p_observed"))


DUAL_SQL = LOG_SQL + """,
dual AS (SELECT level, cycle, avg(vp) AS published, coalesce(avg(vr), avg(vp)) AS revised, count(vp) AS n_published, count(vr) AS n_revised FROM log GROUP BY 1, 2)"""


def dual_stream_table(spark, sf_dir):
    log = team_log(spark, sf_dir)
    return log.groupBy("level", "cycle").agg(
        F.avg("vp").alias("published"), F.coalesce(F.avg("vr"), F.avg("vp")).alias("revised"),
        F.count("vp").alias("n_published"), F.count("vr").alias("n_revised"))


@query("dual_stream", f"WITH {DUAL_SQL} SELECT level, cycle, round(published, 6) AS published, round(revised, 6) AS revised, n_published, n_revised FROM dual")
def dual_stream(spark, sf_dir):
    """As-published and re-derived cycle means in one pass."""
    return dual_stream_table(spark, sf_dir).select(
        "level", "cycle", rnd("published").alias("published"), rnd("revised").alias("revised"), "n_published", "n_revised")


RULE = LeadingRule(window=20, classes=("x",), k=1.0, sustain=3, start=60)
KEYS = ["level", "stream"]
STREAM_SQL = DUAL_SQL + f""",
axis AS (SELECT level, CAST(range AS INTEGER) AS cycle FROM (SELECT DISTINCT level FROM dual), range({WEEKS})),
series AS (SELECT level, 'pub' AS stream, cycle, published AS x FROM axis LEFT JOIN dual USING (level, cycle) UNION ALL
  SELECT level, 'rev', cycle, revised FROM axis LEFT JOIN dual USING (level, cycle)),
""" + P.score_sql("series", KEYS, RULE)


def stream_scores(spark, sf_dir):
    """Score of both streams as columns ``(level, cycle, pub, rev)``."""
    d = densify(dual_stream_table(spark, sf_dir), ["level"], WEEKS)
    both = F.explode(F.array(F.struct(F.lit("pub").alias("stream"), F.col("published").alias("x")),
                             F.struct(F.lit("rev").alias("stream"), F.col("revised").alias("x"))))
    s = alarms.score_series(d.select("level", "cycle", both.alias("r")).select("level", "cycle", "r.*"), KEYS, RULE)
    pick = lambda name: F.max(F.when(F.col("stream") == name, F.col("score"))).alias(name)
    return s.groupBy("level", "cycle").agg(pick("pub"), pick("rev"))


WIDE = f"""
wide AS (SELECT level, cycle, max(score) FILTER (WHERE stream = 'pub') AS pub, max(score) FILTER (WHERE stream = 'rev') AS rev FROM scored GROUP BY 1, 2),
fl AS (SELECT *, sum(CASE WHEN cycle >= 60 AND pub >= 1.0 THEN 1 ELSE 0 END) OVER w = 3 AS hp,
    sum(CASE WHEN cycle >= {T_REV} AND rev >= 1.0 THEN 1 ELSE 0 END) OVER w = 3 AS hr FROM wide WINDOW w AS (PARTITION BY level ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
two AS (SELECT level, min(CASE WHEN hp THEN cycle END) AS t_pre, min(CASE WHEN hr THEN cycle END) AS t_post,
    avg(abs(pub - rev)) FILTER (WHERE cycle >= 60 AND cycle < {T_REV}) AS mean_abs,
    avg(((pub >= 1.0) <> (rev >= 1.0))::INT) FILTER (WHERE cycle >= 60 AND cycle < {T_REV}) AS flip,
    avg(rev - pub) FILTER (WHERE cycle >= 60 AND cycle < {T_REV}) AS lvl, stddev_samp(rev - pub) FILTER (WHERE cycle >= 60 AND cycle < {T_REV}) AS sh FROM fl GROUP BY 1)"""


@query("two_stream_alarm", f"WITH {STREAM_SQL},{WIDE}" + f"""
SELECT level, t_pre, t_post, CASE WHEN t_pre < {T_REV} THEN t_pre ELSE t_post END AS t_lead FROM two""")
def two_stream_alarm(spark, sf_dir):
    """A sequential observer across a retroactive rewrite: an alarm raised before it stands, else the new record is scanned."""
    s = alarms.sustained(stream_scores(spark, sf_dir), ["level"], F.col("pub") >= RULE.k, RULE.sustain, RULE.start, "hp")
    s = alarms.sustained(s, ["level"], F.col("rev") >= RULE.k, RULE.sustain, max(RULE.start, T_REV), "hr")
    g = s.groupBy("level").agg(alarms.first_cycle("hp").alias("t_pre"), alarms.first_cycle("hr").alias("t_post"))
    return g.withColumn("t_lead", F.when(F.col("t_pre") < T_REV, F.col("t_pre")).otherwise(F.col("t_post")))


@query("revision_displacement", f"WITH {STREAM_SQL},{WIDE}" + """
SELECT level, round(mean_abs, 6) AS mean_abs, round(lvl, 6) AS level_shift, round(sh, 6) AS shape_sd, round(flip, 9) AS flip_frac FROM two""")
def revision_displacement(spark, sf_dir):
    """How far the rewrite moved the score: size, level, shape and flips of alarm status before it."""
    s = stream_scores(spark, sf_dir).where((F.col("cycle") >= RULE.start) & (F.col("cycle") < T_REV))
    d = V.displacement(F.col("pub"), F.col("rev"), RULE.k)
    return s.groupBy("level").agg(rnd(d["mean_abs"]).alias("mean_abs"), rnd(d["level"]).alias("level_shift"),
                                  rnd(d["shape_sd"]).alias("shape_sd"), rnd(d["flip_frac"], 9).alias("flip_frac"))


# ------------------------------------------------------------------ propensity correction
P_HAT = f"(SELECT avg(({U} < {AFTER})::INT) FROM (SELECT s_suppkey AS node FROM supplier))"
IPW_SQL = LOG_SQL + f""",
pr AS (SELECT least(0.999, greatest(0.05, {P_HAT})) AS p),
w AS (SELECT level, cycle, vr / CASE WHEN kr >= mh OR mh <= 1 THEN 1.0 ELSE (kr / (kr + 1.0)) / (mh / (mh + 1.0)) END AS x,
    1 / greatest(0.001, 1 - power(1 - p, mh) - mh * p * power(1 - p, mh - 1)) AS w
  FROM (SELECT *, greatest(kr, kr / p) AS mh FROM log, pr WHERE vr IS NOT NULL)),
ipw AS (SELECT level, cycle, sum(w * x) / sum(w) AS corrected FROM w GROUP BY 1, 2),
truth AS (SELECT level, cycle, avg(value) AS truth, avg(vr) AS raw FROM log GROUP BY 1, 2)"""


def corrected_table(spark, sf_dir):
    log = team_log(spark, sf_dir)
    p_hat = M.nodes(spark, sf_dir).agg(F.avg(V.mcar("node", AFTER).cast("double"))).scalar()
    fixed = V.ipw_mean(log, ["level", "cycle"], "kr", "vr", p_hat)
    return log.groupBy("level", "cycle").agg(F.avg("value").alias("truth"), F.avg("vr").alias("raw")).join(fixed, ["level", "cycle"], "left")


@query("ipw_mean", f"WITH {IPW_SQL} SELECT level, cycle, round(truth, 6) AS truth, round(raw, 6) AS raw, round(corrected, 6) AS corrected FROM truth LEFT JOIN ipw USING (level, cycle)")
def ipw_mean(spark, sf_dir):
    """Cycle means before and after the propensity correction, beside the truth."""
    return corrected_table(spark, sf_dir).select("level", "cycle", *[rnd(x).alias(x) for x in ("truth", "raw", "corrected")])


@query("bias_against_truth", f"""WITH {IPW_SQL}
SELECT level, count(raw) AS n_raw, round(avg(raw - truth), 6) AS bias_raw, round(avg(corrected - truth), 6) AS bias_corrected,
  round(abs(avg(raw - truth)) - abs(avg(corrected - truth)), 6) AS bias_reduction FROM truth LEFT JOIN ipw USING (level, cycle) GROUP BY 1""")
def bias_against_truth(spark, sf_dir):
    """Bias of the raw and corrected means over the cycles where both sides are known."""
    raw, fixed = F.avg(F.col("raw") - F.col("truth")), F.avg(F.col("corrected") - F.col("truth"))
    return corrected_table(spark, sf_dir).groupBy("level").agg(
        F.count("raw").alias("n_raw"), rnd(raw).alias("bias_raw"), rnd(fixed).alias("bias_corrected"),
        rnd(F.abs(raw) - F.abs(fixed)).alias("bias_reduction"))


# Newton steps on counted degrees: a recursive table whose rows are the iterates
FIT_SQL = f"""WITH RECURSIVE {MEMBERS_SQL},
t AS (SELECT team, count(*) AS m FROM members GROUP BY 1), d AS (SELECT node, sum(m - 1) AS deg FROM members JOIN t USING (team) GROUP BY 1),
f AS (SELECT s_suppkey AS node, CAST(coalesce(deg, 0) AS DOUBLE) AS deg, s_suppkey FROM supplier LEFT JOIN d ON d.node = s_suppkey),
marked AS (SELECT node, deg, {U} < {AFTER} AS visible, {U} < {BEFORE} AS seen_before FROM f),
h AS (SELECT deg, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE visible) AS DOUBLE) AS k FROM marked GROUP BY 1),
mo AS (SELECT sum(n * deg) / sum(n) AS mean, sqrt(greatest(sum(n * deg * deg) / sum(n) - power(sum(n * deg) / sum(n), 2), 0)) AS sd0 FROM h),
mom AS (SELECT mean, CASE WHEN sd0 > 1e-9 THEN sd0 ELSE 1 END AS sd FROM mo),
hx AS (SELECT (deg - mean) / sd AS x, n, k FROM h, mom),
newton(i, w0, w1, moved) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, w0 + (c * g0 - b * g1) / (a * c - b * b), w1 + (a * g1 - b * g0) / (a * c - b * b),
    greatest(abs((c * g0 - b * g1) / (a * c - b * b)), abs((a * g1 - b * g0) / (a * c - b * b)))
  FROM (SELECT i, w0, w1, sum(k - n * p) - {V.RIDGE} * w0 AS g0, sum((k - n * p) * x) - {V.RIDGE} * w1 AS g1, sum(v) + {V.RIDGE} AS a, sum(v * x) AS b,
      sum(v * x * x) + {V.RIDGE} AS c
    FROM (SELECT *, n * (p * (1 - p) + 1e-9) AS v FROM (SELECT w.i, w.w0, w.w1, hx.*, 1 / (1 + exp(-greatest(-30, least(30, w.w0 + w.w1 * x)))) AS p
      FROM newton w, hx WHERE w.moved >= 1e-8 AND w.i < 200)) GROUP BY 1, 2, 3)),
fit AS (SELECT w0, w1 FROM newton ORDER BY i DESC LIMIT 1),
pi AS (SELECT *, greatest(0.02, least(1, 1 / (1 + exp(-greatest(-30, least(30, w0 + w1 * (deg - mean) / sd)))))) AS p FROM marked, mom, fit)"""


@query("propensity_fit", FIT_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE visible) AS n_visible, round(any_value(w0), 6) AS intercept, round(any_value(w1), 6) AS slope,
  round(avg(p), 6) AS p_hat, round(avg(p) FILTER (WHERE visible), 6) AS p_visible, count(*) FILTER (WHERE seen_before AND NOT visible) AS mislabelled FROM pi""")
def propensity_fit(spark, sf_dir):
    """Logistic fit of visibility on cumulative degree with its predictions averaged over nodes."""
    z = centrality_z(spark, sf_dir).withColumn("visible", V.mcar("node", AFTER))
    fit = V.propensity_fit(z, "visible", "deg")
    pi = V.propensity(fit, "deg")
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("n_visible"), rnd(F.lit(fit["intercept"])).alias("intercept"),
                 rnd(F.lit(fit["slope"])).alias("slope"), rnd(F.avg(pi)).alias("p_hat"), rnd(F.avg(F.when(F.col("visible"), pi))).alias("p_visible"),
                 F.count_if(V.mcar("node", BEFORE) & ~F.col("visible")).alias("mislabelled"))


@query("revocation_contrast", f"""WITH {LOG_SQL},
r AS (SELECT level, cycle, avg(vp) FILTER (WHERE cycle < {T_REV}) AS x_rev, avg(vr) FILTER (WHERE cycle < {T_REV}) AS x_static,
   count(vp) AS np, count(vr) AS nr FROM log WHERE cycle < {T_REV} GROUP BY 1, 2),
s AS (SELECT level, count(*) AS n, avg(x_rev - x_static) AS d, stddev_samp(x_rev - x_static) / sqrt(count(x_rev - x_static)) AS se, sum(nr) / sum(np) AS cov FROM r GROUP BY 1)
SELECT level, n, round(d, 6) AS difference, round(se, 6) AS se, abs(d) > 1.959963984540054 * se AS distinguishable, round(cov, 9) AS coverage_ratio FROM s""")
def revocation_contrast(spark, sf_dir):
    """Record before a revocation against the record of equal final coverage from the start, paired by cycle."""
    r = team_log(spark, sf_dir).where(F.col("cycle") < T_REV).groupBy("level", "cycle").agg(
        (F.avg("vp") - F.avg("vr")).alias("x"), F.count("vp").alias("np"), F.count("vr").alias("nr"))
    d, se = F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count("x"))
    return r.groupBy("level").agg(F.count(F.lit(1)).alias("n"), rnd(d).alias("difference"), rnd(se).alias("se"),
                                  (F.abs(d) > 1.959963984540054 * se).alias("distinguishable"), rnd(F.sum("nr") / F.sum("np"), 9).alias("coverage_ratio"))
