"""Bootstrap and permutation queries over independent groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import rnd
from tidewatch.functions.intervals import excludes_zero, rate, verdict
from tidewatch.operators import resample as B
from tidewatch.operators import survival as S
from tidewatch.operators.cells import crossing
from tidewatch.operators.resample import slot_number_sql
from tidewatch.plans.inference import COLLAPSED, GROUPS, comparator_leads, comparator_matching, group_rates
from tidewatch.plans.registry import ORACLES, query
from tidewatch.sources import runs as R
from tidewatch.sources.runs import GROUP, user_runs, user_runs_sql
from tidewatch.sources.tables import unit_hash_sql

RUNS = f"WITH {user_runs_sql()}"
KEY_SQL = "(c || '|' || arm || '|' || rep)"
SEED = 41011


def group_key():
    return F.concat_ws("|", "c", "arm", "rep")


def boot_sql(values: str, strata: str, columns: tuple[str, ...], draws: int, seed: int) -> str:
    """CTEs ending in ``boot(strata, draw, n, columns)``; ``values`` has ``strata, key, columns``."""
    sums = ", ".join(f"sum(v.{c}) AS {c}" for c in columns)
    on = " AND ".join(f"v.{s.strip()} = s.{s.strip()}" for s in strata.split(","))
    pick = ", ".join(f"s.{x.strip()}" for x in strata.split(","))
    return f"""
vals AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5(CAST(key AS VARCHAR))) - 1 AS idx FROM {values}),
sizes AS (SELECT {strata}, count(*) AS n FROM vals GROUP BY {strata}),
slots AS (SELECT {strata}, n, d.range AS draw, {slot_number_sql(seed, 'd.range', 't.range')} % n AS idx
  FROM sizes, range({draws}) d, range((SELECT max(n) FROM sizes)) t WHERE t.range < n),
boot AS (SELECT {pick}, s.draw, max(s.n) AS n, {sums} FROM slots s JOIN vals v ON {on} AND v.idx = s.idx GROUP BY {pick}, s.draw)"""


LEADS = RUNS + f""",
val AS (SELECT c, arm, {KEY_SQL} AS key, avg(dt_censored) AS x FROM runs WHERE scen = 'degrade' GROUP BY c, arm, rep)"""


def group_leads(spark, sf_dir):
    """Mean censored lead per independent group."""
    return user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy(*GROUP).agg(
        F.avg("dt_censored").alias("x")).withColumn("key", group_key())


@query("bootstrap_mean", f"""{LEADS},{boot_sql('val', 'c, arm', ('x',), 2000, 41015)},
p AS (SELECT c, arm, avg(x) AS mean, count(*) AS n FROM val GROUP BY 1, 2),
i AS (SELECT c, arm, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1, 2)
SELECT c, arm, n, round(mean, 6) AS mean, round(se, 6) AS se, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95 FROM p JOIN i USING (c, arm)""")
def bootstrap_mean(spark, sf_dir):
    """Mean, bootstrap error and percentile interval over 2,000 draws of the group leads of every cell."""
    out = B.bootstrap_mean(group_leads(spark, sf_dir), ["c", "arm"], "key", "x", 2000, 41015)
    return out.select("c", "arm", "n", *[rnd(x).alias(x) for x in ("mean", "se", "lo95", "hi95")])


@query("paired_bootstrap", RUNS + f""",
val AS (SELECT c, {KEY_SQL} || colour AS key, CAST(dt_paired AS DOUBLE) AS x FROM runs WHERE scen = 'degrade' AND dt_paired IS NOT NULL),
{boot_sql('val', 'c', ('x',), 500, 41012)},
p AS (SELECT c, avg(x) AS mean, count(*) AS n, median(x) AS med, avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END) AS earlier FROM val GROUP BY 1),
i AS (SELECT c, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1)
SELECT c, n, round(mean, 6) AS mean, round(med, 6) AS median, round(earlier, 9) AS frac_lead_earlier, round(se, 6) AS se, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95,
  CASE WHEN lo95 > 0 THEN 'beats' WHEN hi95 < 0 THEN 'loses' ELSE 'matches' END AS verdict FROM p JOIN i USING (c)""")
def paired_bootstrap(spark, sf_dir):
    """Paired lead among runs where both fired, with a verdict read from its interval."""
    v = user_runs(spark, sf_dir).where("scen = 'degrade' AND dt_paired IS NOT NULL").select(
        "c", F.concat(group_key(), "colour").alias("key"), F.col("dt_paired").cast("double").alias("x"))
    out = B.bootstrap_mean(v, ["c"], "key", "x", 500, 41012)
    extra = v.groupBy("c").agg(F.median("x").alias("median"), rate(F.col("x") > 0).alias("earlier"))
    return out.join(extra, "c").select(
        "c", "n", rnd("mean").alias("mean"), rnd("median").alias("median"), rnd("earlier", 9).alias("frac_lead_earlier"),
        *[rnd(x).alias(x) for x in ("se", "lo95", "hi95")], verdict("lo95", "hi95").alias("verdict"))


@query("cluster_bootstrap", RUNS + f""",
val AS (SELECT c, {KEY_SQL} AS key, avg(lead_fired::INT) AS f, avg(lag_fired::INT) AS g FROM runs WHERE scen = 'control' GROUP BY c, arm, rep),
{boot_sql('val', 'c', ('f', 'g'), 2000, 41013)},
q AS (SELECT c, f / n AS m, row_number() OVER (PARTITION BY c ORDER BY f / n) - 1 AS r FROM boot)
SELECT c, (SELECT round(avg(f), 9) FROM val v WHERE v.c = q.c) AS point, round(max(m) FILTER (WHERE r = 50), 9) AS lo95, round(max(m) FILTER (WHERE r = 1950), 9) AS hi95,
  round(max(m) FILTER (WHERE r = 1949), 9) AS hi95_shifted FROM q GROUP BY c""")
def cluster_bootstrap(spark, sf_dir):
    """Interval of the group false-alarm rate by resampling whole groups, ends read as sorted draws."""
    v = user_runs(spark, sf_dir).where("scen = 'control'").groupBy(*GROUP).agg(rate("lead_fired").alias("f")).withColumn("key", group_key())
    draws = B.bootstrap_sums(v, ["c"], "key", ["f"], 2000, 41013).withColumn("m", F.col("f") / F.col("n"))
    ends = B.order_statistic_interval(draws, ["c"], "m", 2000)
    shifted = B.order_statistic_interval(draws, ["c"], "m", 2000, upper_shift=1).select("c", F.col("hi95").alias("hi95_shifted"))
    return v.groupBy("c").agg(F.avg("f").alias("point")).join(ends, "c").join(shifted, "c").select(
        "c", *[rnd(x, 9).alias(x) for x in ("point", "lo95", "hi95", "hi95_shifted")])


@query("bootstrap_ratio", RUNS + f""",
val AS (SELECT arm, {KEY_SQL} AS key, sum(abs(dt_censored)) AS raw, sum(abs(dt_censored)) FILTER (WHERE colour = 'systematic') AS cor FROM runs WHERE scen = 'degrade' GROUP BY c, arm, rep),
{boot_sql('val', 'arm', ('raw', 'cor'), 1000, SEED)},
i AS (SELECT arm, quantile_cont(1 - cor / nullif(raw, 0), 0.025) AS lo95, quantile_cont(1 - cor / nullif(raw, 0), 0.975) AS hi95 FROM boot GROUP BY 1)
SELECT arm, (SELECT count(*) FROM val v WHERE v.arm = i.arm) AS n, (SELECT round(1 - sum(cor) / sum(raw), 9) FROM val v WHERE v.arm = i.arm) AS reduction,
  round(lo95, 9) AS lo95, round(hi95, 9) AS hi95 FROM i""")
def bootstrap_ratio(spark, sf_dir):
    """Interval of a pooled reduction, one minus a ratio of sums resampled together."""
    a = F.abs("dt_censored").cast("double")
    v = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy(*GROUP).agg(
        F.sum(a).alias("raw"), F.sum(F.when(F.col("colour") == "systematic", a)).alias("cor")).withColumn("key", group_key())
    draws = B.bootstrap_sums(v, ["arm"], "key", ["raw", "cor"], 1000, SEED)
    i = B.percentile_interval(draws.withColumn("r", 1 - F.try_divide("cor", "raw")), ["arm"], "r")
    point = v.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (1 - F.sum("cor") / F.sum("raw")).alias("reduction"))
    return point.join(i, "arm").select("arm", "n", *[rnd(x, 9).alias(x) for x in ("reduction", "lo95", "hi95")])


FLOOR_DRAWS = 400


@query("floor_bootstrap", RUNS + f""",
val AS (SELECT arm, c, {KEY_SQL} AS key, avg(dt_censored) AS dt, avg(lead_fired::INT) AS det FROM runs WHERE scen = 'degrade' GROUP BY c, arm, rep),
{boot_sql('val', 'arm, c', ('dt', 'det'), FLOOR_DRAWS, 20260806)},
curve AS (SELECT arm, draw, est, c, a, lead(a) OVER w AS b, lead(c) OVER w AS c2
  FROM (SELECT arm, draw, c, unnest(['dt', 'det']) AS est, unnest([dt / n, det / n - 0.4]) AS a FROM boot) WINDOW w AS (PARTITION BY arm, draw, est ORDER BY c)),
x AS (SELECT arm, draw, est, arg_min(c + (c2 - c) * (-a) / (b - a), c) FILTER (WHERE (a <= 0) <> (b <= 0)) AS floor_c FROM curve GROUP BY 1, 2, 3)
SELECT arm, est, count(floor_c) AS n_resolved, round(avg(floor_c), 6) AS mean, round(quantile_cont(floor_c, 0.025), 6) AS lo95, round(quantile_cont(floor_c, 0.975), 6) AS hi95
FROM x GROUP BY 1, 2""")
def floor_bootstrap(spark, sf_dir):
    """Bootstrap of a derived crossing: resample cells, rebuild the curve, find its floor, in every draw."""
    return _floors(spark, sf_dir).groupBy("arm", "est").agg(
        F.count("floor_c").alias("n_resolved"), rnd(F.avg("floor_c")).alias("mean"),
        rnd(F.expr("percentile(floor_c, 0.025)")).alias("lo95"), rnd(F.expr("percentile(floor_c, 0.975)")).alias("hi95"))


def _floors(spark, sf_dir):
    v = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy(*GROUP).agg(
        F.avg("dt_censored").alias("dt"), rate("lead_fired").alias("det")).withColumn("key", group_key())
    draws = B.bootstrap_sums(v, ["arm", "c"], "key", ["dt", "det"], FLOOR_DRAWS, 20260806)
    curves = draws.select("arm", "c", "draw", (F.col("dt") / F.col("n")).alias("dt"), (F.col("det") / F.col("n") - 0.4).alias("det"))
    long = curves.unpivot(["arm", "c", "draw"], ["dt", "det"], "est", "y")
    return crossing(long, ["arm", "draw", "est"], "c", "y", out="floor_c")


WIN_SQL = "lead_fired AND (NOT lag_fired OR t_lead < t_lag)"


@query("floor_bootstrap_by_colour", RUNS + f""",
val AS (SELECT arm, colour, c, {KEY_SQL} AS key, avg(dt_censored) AS dt, avg(lead_fired::INT) AS det, CAST(count(*) FILTER (WHERE {WIN_SQL}) AS DOUBLE) AS won,
  CAST(count(*) FILTER (WHERE lead_fired OR lag_fired) AS DOUBLE) AS decided FROM runs WHERE scen = 'degrade' GROUP BY c, arm, colour, rep),
{boot_sql('val', 'arm, colour, c', ('dt', 'det', 'won', 'decided'), FLOOR_DRAWS, 20260807)},
curve AS (SELECT arm, colour, draw, est, c, a, lead(a) OVER w AS b, lead(c) OVER w AS c2
  FROM (SELECT arm, colour, draw, c, unnest(['dt', 'det', 'win']) AS est, unnest([dt / n, det / n - 0.4, won / nullif(decided, 0) - 0.5]) AS a FROM boot)
  WINDOW w AS (PARTITION BY arm, colour, draw, est ORDER BY c)),
x AS (SELECT arm, colour, draw, est, arg_min(c + (c2 - c) * (-a) / (b - a), c) FILTER (WHERE (a <= 0) <> (b <= 0)) AS floor_c FROM curve GROUP BY 1, 2, 3, 4)
SELECT arm, colour, est, count(floor_c) AS n_resolved, round(avg(floor_c), 6) AS mean, round(quantile_cont(floor_c, 0.025), 6) AS lo95,
  round(quantile_cont(floor_c, 0.975), 6) AS hi95 FROM x GROUP BY 1, 2, 3""")
def floor_bootstrap_by_colour(spark, sf_dir):
    """The floor of every variant by mean lead, detection and probability of winning, found anew in every draw.

    Wins and decided runs are resampled together and divided within the draw; a draw without a decided run has no point there.
    """
    v = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy(*GROUP, "colour").agg(
        F.avg("dt_censored").alias("dt"), rate("lead_fired").alias("det"), F.count_if(S.lead_first()).cast("double").alias("won"),
        F.count_if(S.any_fired()).cast("double").alias("decided")).withColumn("key", group_key())
    draws = B.bootstrap_sums(v, ["arm", "colour", "c"], "key", ["dt", "det", "won", "decided"], FLOOR_DRAWS, 20260807)
    curves = draws.select("arm", "colour", "c", "draw", (F.col("dt") / F.col("n")).alias("dt"), (F.col("det") / F.col("n") - 0.4).alias("det"),
                          (F.try_divide("won", "decided") - 0.5).alias("win"))
    long = curves.unpivot(["arm", "colour", "c", "draw"], ["dt", "det", "win"], "est", "y")
    floors = crossing(long, ["arm", "colour", "draw", "est"], "c", "y", out="floor_c")
    return floors.groupBy("arm", "colour", "est").agg(
        F.count("floor_c").alias("n_resolved"), rnd(F.avg("floor_c")).alias("mean"),
        rnd(F.expr("percentile(floor_c, 0.025)")).alias("lo95"), rnd(F.expr("percentile(floor_c, 0.975)")).alias("hi95"))


@query("floor_gap", RUNS + f""",
val AS (SELECT arm, c, {KEY_SQL} AS key, avg(dt_censored) AS dt, avg(lead_fired::INT) AS det FROM runs WHERE scen = 'degrade' GROUP BY c, arm, rep),
{boot_sql('val', 'arm, c', ('dt', 'det'), FLOOR_DRAWS, 20260806)},
curve AS (SELECT arm, draw, c, a, lead(a) OVER w AS b, lead(c) OVER w AS c2
  FROM (SELECT arm, draw, c, dt / n AS a FROM boot) WINDOW w AS (PARTITION BY arm, draw ORDER BY c)),
x AS (SELECT arm, draw, arg_min(c + (c2 - c) * (-a) / (b - a), c) FILTER (WHERE (a <= 0) <> (b <= 0)) AS f FROM curve GROUP BY 1, 2),
g AS (SELECT draw, max(f) FILTER (WHERE arm = 'mcar') - max(f) FILTER (WHERE arm = 'mnar') AS gap FROM x GROUP BY 1)
SELECT count(gap) AS n_both, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.025), 6) AS lo95, round(quantile_cont(gap, 0.975), 6) AS hi95,
  round(avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE WHEN gap IS NOT NULL THEN 0 END), 9) AS p_gap_positive, quantile_cont(gap, 0.025) < 0 AND quantile_cont(gap, 0.975) > 0 AS straddles_zero FROM g""")
def floor_gap(spark, sf_dir):
    """Gap between the floors of the two arms, over draws that resolve both."""
    f = _floors(spark, sf_dir).where("est = 'dt'").groupBy("draw").pivot("arm", ["mcar", "mnar"]).agg(F.max("floor_c"))
    g = f.withColumn("gap", F.col("mcar") - F.col("mnar"))
    lo, hi = F.expr("percentile(gap, 0.025)"), F.expr("percentile(gap, 0.975)")
    return g.agg(F.count("gap").alias("n_both"), rnd(F.avg("gap")).alias("mean_gap"), rnd(lo).alias("lo95"), rnd(hi).alias("hi95"),
                 rnd(rate(F.col("gap") > 0), 9).alias("p_gap_positive"), ((lo < 0) & (hi > 0)).alias("straddles_zero"))


PERM_DRAWS = 999


@query("permutation_heterogeneity", f"""{RUNS.replace('WITH', 'WITH RECURSIVE', 1)}, {GROUPS},
pv AS (SELECT detector, arm, c, f, row_number() OVER (PARTITION BY detector, arm ORDER BY md5({KEY_SQL})) - 1 AS idx, count(*) OVER (PARTITION BY detector, arm) AS n FROM g),
ov AS (SELECT detector, avg(f) AS m FROM pv GROUP BY 1),
obs AS (SELECT detector, sum(n * power(cm - m, 2)) AS stat FROM (SELECT detector, c, count(*) AS n, avg(f) AS cm FROM pv GROUP BY 1, 2) JOIN ov USING (detector) GROUP BY 1),
keys AS (SELECT d.range AS draw, {B.round_key_sql(SEED, 'd.range')} AS k FROM range({PERM_DRAWS}) d),
walk AS (SELECT detector, arm, f, n, draw, k, {B.keyed_place_sql('idx', 'n', 'k')} AS x FROM pv, keys
  UNION ALL SELECT detector, arm, f, n, draw, k, {B.keyed_place_sql('x', 'n', 'k')} FROM walk WHERE x >= n),
mv AS (SELECT s.detector, s.draw, v.c, count(*) AS n, avg(s.f) AS cm FROM walk s JOIN pv v ON v.detector = s.detector AND v.arm = s.arm AND v.idx = s.x GROUP BY 1, 2, 3),
dr AS (SELECT detector, draw, sum(n * power(cm - m, 2)) AS stat FROM mv JOIN ov USING (detector) GROUP BY 1, 2)
SELECT d.detector, round(max(o.stat), 9) AS statistic, count(*) FILTER (WHERE d.stat >= o.stat - 1e-9) AS exceedances,
  round((count(*) FILTER (WHERE d.stat >= o.stat - 1e-9) + 1) / {PERM_DRAWS + 1}.0, 9) AS p FROM dr d JOIN obs o USING (detector) GROUP BY 1""")
def permutation_heterogeneity(spark, sf_dir):
    """Permutation test of coverage heterogeneity, groups shuffled within their arm."""
    g = group_rates(spark, sf_dir).withColumn("key", group_key())
    out = B.permutation_heterogeneity(g, ["detector"], "key", "c", "arm", "f", PERM_DRAWS, SEED)
    return out.select("detector", rnd("statistic", 9).alias("statistic"), "exceedances", rnd("p", 9).alias("p"))


LEAD_VERDICT = f"""{RUNS}, {COLLAPSED},
val AS (SELECT detector, {KEY_SQL} AS key, gain AS x FROM lead),{boot_sql('val', 'detector', ('x',), 500, 41014)},
i AS (SELECT detector, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1)
SELECT detector, (SELECT round(avg(x), 6) FROM val v WHERE v.detector = i.detector) AS mean, round(se, 6) AS se, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95,
  CASE WHEN lo95 > 0 THEN 'beats' WHEN hi95 < 0 THEN 'loses' ELSE 'matches' END AS verdict, lo95 > 0 OR hi95 < 0 AS excludes_zero FROM i"""


@query("comparator_lead_bootstrap", LEAD_VERDICT)
def comparator_lead_bootstrap(spark, sf_dir):
    """Does a detector beat, match or lose to the comparator? Read from the interval of its group leads."""
    v = comparator_leads(spark, sf_dir).select("detector", group_key().alias("key"), F.col("gain").alias("x"))
    out = B.bootstrap_mean(v, ["detector"], "key", "x", 500, 41014)
    return out.select("detector", *[rnd(x).alias(x) for x in ("mean", "se", "lo95", "hi95")], verdict("lo95", "hi95").alias("verdict"),
                      excludes_zero("lo95", "hi95").alias("excludes_zero"))


@query("comparator_verdict", f"""WITH b AS ({LEAD_VERDICT}), m AS ({ORACLES['comparator_matching']})
SELECT detector, m.matched AS comparable, CASE WHEN m.matched THEN b.mean END AS mean, CASE WHEN m.matched THEN b.lo95 END AS lo95,
  CASE WHEN m.matched THEN b.hi95 END AS hi95, CASE WHEN m.matched THEN b.verdict ELSE 'not comparable' END AS verdict
FROM b JOIN m USING (detector) WHERE m.level = 'run'""")
def comparator_verdict(spark, sf_dir):
    """Beats, loses or matches, but only for a detector whose false-alarm rate matches the comparator's: leads bought with
    more false alarms are not compared."""
    rates = comparator_matching(spark, sf_dir).where("level = 'run'").select("detector", F.col("matched").alias("comparable"))
    gated = lambda x: F.when(F.col("comparable"), F.col(x)).alias(x)
    return comparator_lead_bootstrap(spark, sf_dir).join(rates, "detector").select(
        "detector", "comparable", gated("mean"), gated("lo95"), gated("hi95"),
        F.when(F.col("comparable"), F.col("verdict")).otherwise("not comparable").alias("verdict"))


@query("matched_seed_sensitivity", RUNS + f""",
b AS (SELECT seed, c, dt_censored FROM runs WHERE scen = 'degrade' AND colour = 'white'), v AS (SELECT seed, colour, dt_censored FROM runs WHERE scen = 'degrade' AND colour <> 'white'),
val AS (SELECT v.colour, v.seed AS key, CAST(v.dt_censored - b.dt_censored AS DOUBLE) AS x FROM v JOIN b USING (seed)),{boot_sql('val', 'colour', ('x',), 400, SEED)},
i AS (SELECT colour, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1)
SELECT colour, (SELECT count(*) FROM val v WHERE v.colour = i.colour) AS n, 0::BIGINT AS unmatched, (SELECT round(avg(x), 6) FROM val v WHERE v.colour = i.colour) AS mean,
  round(se, 6) AS se, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95 FROM i""")
def matched_seed_sensitivity(spark, sf_dir):
    """Variants against the base variant on equal seeds; seeds without a partner are counted."""
    deg = user_runs(spark, sf_dir).where("scen = 'degrade'")
    x = lambda col: F.max(F.when(F.col("colour") == col, F.col("dt_censored").cast("double")))
    per_seed = deg.groupBy("seed").agg(*[x(c).alias(c) for c in R.COLOURS])
    long = per_seed.unpivot(["seed", "white"], ["red", "systematic"], "colour", "y").withColumn("x", F.col("y") - F.col("white"))
    lost = long.groupBy("colour").agg(F.count_if(F.col("x").isNull()).alias("unmatched"))
    out = B.bootstrap_mean(long, ["colour"], "seed", "x", 400, SEED)
    return out.join(lost, "colour").select("colour", "n", "unmatched", *[rnd(c).alias(c) for c in ("mean", "se", "lo95", "hi95")])


CONTRAST = RUNS + f""",
p AS (SELECT c, rep, colour, max(abs(dt_censored)) FILTER (WHERE arm = 'mnar') AS a, max(abs(dt_censored)) FILTER (WHERE arm = 'mcar') AS b FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3),
val AS (SELECT colour, c || '|' || rep AS key, CAST(a - b AS DOUBLE) AS x FROM p WHERE a IS NOT NULL AND b IS NOT NULL),{boot_sql('val', 'colour', ('x',), 500, 77)},
i AS (SELECT colour, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1),
s AS (SELECT colour, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM val GROUP BY 1)
SELECT colour, n, round(mean, 6) AS mean, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95, lo95 > 0 OR hi95 < 0 AS resolved, CAST(sign(mean) AS INTEGER) AS direction,
  round({1.959963984540054 + 0.8416212335729143} * sd / sqrt(n), 6) AS mde FROM s JOIN i USING (colour)"""


@query("matched_pair_contrast", CONTRAST)
def matched_pair_contrast(spark, sf_dir):
    """Difference of magnitudes between paired arms, pooled over coverage, with a mechanical verdict."""
    from tidewatch.functions.intervals import Z80, Z95
    a = lambda arm: F.max(F.when(F.col("arm") == arm, F.abs("dt_censored").cast("double")))
    p = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy("c", "rep", "colour").agg((a("mnar") - a("mcar")).alias("x"))
    v = p.where("x IS NOT NULL").select("colour", F.concat_ws("|", "c", "rep").alias("key"), "x")
    sd = v.groupBy("colour").agg(F.stddev_samp("x").alias("sd"))
    out = B.bootstrap_mean(v, ["colour"], "key", "x", 500, 77).join(sd, "colour")
    return out.select("colour", "n", *[rnd(x).alias(x) for x in ("mean", "lo95", "hi95")], excludes_zero("lo95", "hi95").alias("resolved"),
                      F.signum("mean").cast("int").alias("direction"), rnd((Z95 + Z80) * F.col("sd") / F.sqrt("n")).alias("mde"))


@query("matched_pair_by_coverage", RUNS + f""",
p AS (SELECT c, rep, colour, max(abs(dt_censored)) FILTER (WHERE arm = 'mnar') AS a, max(abs(dt_censored)) FILTER (WHERE arm = 'mcar') AS b FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3),
val AS (SELECT colour, c, CAST(rep AS VARCHAR) AS key, CAST(a - b AS DOUBLE) AS x FROM p WHERE a IS NOT NULL AND b IS NOT NULL),{boot_sql('val', 'colour, c', ('x',), 500, 78)},
i AS (SELECT colour, c, stddev_samp(x / n) AS se, quantile_cont(x / n, 0.025) AS lo95, quantile_cont(x / n, 0.975) AS hi95 FROM boot GROUP BY 1, 2),
s AS (SELECT colour, c, count(*) AS n, avg(x) AS mean FROM val GROUP BY 1, 2)
SELECT colour, c, n, round(mean, 6) AS mean, round(se, 6) AS se, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95 FROM s JOIN i USING (colour, c)""")
def matched_pair_by_coverage(spark, sf_dir):
    """The paired contrast of magnitudes at every coverage by itself."""
    a = lambda arm: F.max(F.when(F.col("arm") == arm, F.abs("dt_censored").cast("double")))
    p = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy("c", "rep", "colour").agg((a("mnar") - a("mcar")).alias("x"))
    v = p.where("x IS NOT NULL").select("colour", "c", F.col("rep").cast("string").alias("key"), "x")
    out = B.bootstrap_mean(v, ["colour", "c"], "key", "x", 500, 78)
    return out.select("colour", "c", "n", *[rnd(x).alias(x) for x in ("mean", "se", "lo95", "hi95")])


@query("matched_pair_verdict", f"""WITH p AS ({CONTRAST})
SELECT count(*) AS n_variants, count(*) FILTER (WHERE resolved) AS n_resolved, min(direction) AS least_direction, max(direction) AS most_direction,
  CASE WHEN NOT bool_and(resolved) THEN 'unresolved' WHEN count(DISTINCT direction) = 1 THEN 'resolved' ELSE 'direction depends on the variant' END AS verdict,
  round(max(mde), 6) AS largest_mde FROM p""")
def matched_pair_verdict(spark, sf_dir):
    """One verdict over all variants: resolved if every interval leaves zero out and all point the same way."""
    p = matched_pair_contrast(spark, sf_dir)
    verdict_ = F.when(~F.bool_and("resolved"), "unresolved").when(F.count_distinct("direction") == 1, "resolved").otherwise("direction depends on the variant")
    return p.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if("resolved").alias("n_resolved"), F.min("direction").alias("least_direction"),
                 F.max("direction").alias("most_direction"), verdict_.alias("verdict"), rnd(F.max("mde")).alias("largest_mde"))


POISSON_WEIGHT = " + ".join(f"CASE WHEN u > {p!r} THEN 1 ELSE 0 END" for p in B.POISSON_CDF)


@query("poisson_bootstrap", f"""
WITH u AS (SELECT o_orderpriority, o_totalprice, d.range AS draw, {unit_hash_sql('poisson7', 'd.range', 'o_orderkey')} AS u FROM orders, range(100) d),
w AS (SELECT o_orderpriority, draw, o_totalprice, {POISSON_WEIGHT} AS w FROM u),
m AS (SELECT o_orderpriority, draw, sum(w * o_totalprice) / sum(w) AS m FROM w GROUP BY 1, 2),
p AS (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT o_orderpriority, round(any_value(mean), 4) AS mean, round(stddev_samp(m), 4) AS se, round(quantile_cont(m, 0.025), 4) AS lo95, round(quantile_cont(m, 0.975), 4) AS hi95
FROM m JOIN p USING (o_orderpriority) GROUP BY 1""")
def poisson_bootstrap(spark, sf_dir):
    """Weighted bootstrap of the mean order value per priority over all orders, without expanding slots."""
    o = R.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    sums = B.poisson_sums(o, ["o_orderpriority"], "o_orderkey", ["o_totalprice"], 100, 7)
    draws = sums.withColumn("m", F.col("o_totalprice") / F.col("n"))
    i = B.percentile_interval(draws, ["o_orderpriority"], "m")
    point = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return point.join(i, "o_orderpriority").select("o_orderpriority", *[rnd(x, 4).alias(x) for x in ("mean", "se", "lo95", "hi95")])
