"""Group-level inference: heterogeneity, comparisons, multiplicity, ranks, comparator leads, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import rnd
from tidewatch.functions.intervals import Z95, rate, two_proportion_z, wilson, wilson_sql
from tidewatch.functions.tails import chi2_upper, chi2_upper_sql, normal_two_sided, normal_two_sided_sql
from tidewatch.operators import cells, mixture
from tidewatch.operators.inference import adjust_p, guarded_corr, mean_test, spearman
from tidewatch.plans.registry import query
from tidewatch.sources import runs as R
from tidewatch.sources import tables as T
from tidewatch.sources.runs import DETECTORS, GROUP, user_runs

RUNS = f"WITH {R.user_runs_sql()}"
CONTROL = "(SELECT * FROM runs WHERE scen = 'control')"
LONG = f"d AS ({R.detectors_long_sql(CONTROL, 'c, arm, rep')})"
GROUPS = LONG + """,
g AS (SELECT c, arm, rep, detector, avg(CASE WHEN t IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS f FROM d GROUP BY 1, 2, 3, 4)"""


def control_long(spark, sf_dir):
    return R.detectors_long(user_runs(spark, sf_dir).where("scen = 'control'"), GROUP)


def group_rates(spark, sf_dir):
    """Share of copies that fired, per independent group and detector."""
    return control_long(spark, sf_dir).groupBy(*GROUP, "detector").agg(rate(F.col("t").isNotNull()).alias("f"))


def both_levels(spark, sf_dir):
    """(k, n) per coverage and detector counted over runs and over groups, from one group table."""
    g = control_long(spark, sf_dir).groupBy(*GROUP, "detector").agg(
        F.count("t").alias("k"), F.count(F.lit(1)).alias("n"))
    c = g.groupBy("c", "detector").agg(
        F.sum("k").cast("double").alias("kr"), F.sum("n").cast("double").alias("nr"),
        F.sum(F.col("k") / F.col("n")).alias("kg"), F.count(F.lit(1)).cast("double").alias("ng"))
    return c.select("c", "detector", F.explode(F.array(
        F.struct(F.lit("run").alias("level"), F.col("kr").alias("k"), F.col("nr").alias("n")),
        F.struct(F.lit("group").alias("level"), F.col("kg").alias("k"), F.col("ng").alias("n")))).alias("s")).select("c", "detector", "s.*")


LEVELS = GROUPS + """,
lv AS (SELECT c, detector, 'run' AS level, CAST(count(t) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1, 2
  UNION ALL SELECT c, detector, 'group', sum(f), CAST(count(*) AS DOUBLE) FROM g GROUP BY 1, 2)"""


@query("rate_heterogeneity", f"{RUNS}, {LEVELS}," + """
p AS (SELECT *, sum(k) OVER w / sum(n) OVER w AS p FROM lv WINDOW w AS (PARTITION BY detector, level)),
h AS (SELECT detector, level, sum((k - n*p)*(k - n*p)/(n*p*(1-p))) AS chi2, count(*) - 1 AS df, max(p) AS pooled FROM p GROUP BY 1, 2)""" + f"""
SELECT detector, level, round(chi2, 6) AS chi2, df, round(pooled, 9) AS pooled_rate, round({chi2_upper_sql('chi2', 'df')}, 8) AS p FROM h""")
def rate_heterogeneity(spark, sf_dir):
    """Chi-square of one alarm rate over coverage cells, counted over runs and over independent groups."""
    h = cells.heterogeneity(both_levels(spark, sf_dir), ["detector", "level"])
    return h.select("detector", "level", rnd("chi2").alias("chi2"), "df", rnd("pooled_rate", 9).alias("pooled_rate"),
                    rnd(chi2_upper(F.col("chi2"), F.col("df").cast("double")), 8).alias("p"))


@query("design_effect", f"{RUNS}, {LEVELS}," + """
p AS (SELECT *, sum(k) OVER w / sum(n) OVER w AS p FROM lv WINDOW w AS (PARTITION BY detector, level)),
h AS (SELECT detector, level, sum((k - n*p)*(k - n*p)/(n*p*(1-p))) AS chi2 FROM p GROUP BY 1, 2)
SELECT detector, round(max(chi2) FILTER (WHERE level = 'run'), 6) AS run_chi2, round(max(chi2) FILTER (WHERE level = 'group'), 6) AS group_chi2,
  round(max(chi2) FILTER (WHERE level = 'run') / max(chi2) FILTER (WHERE level = 'group'), 6) AS ratio FROM h GROUP BY 1""")
def design_effect(spark, sf_dir):
    """How far counting copies as replicates inflates the statistic."""
    h = cells.heterogeneity(both_levels(spark, sf_dir), ["detector", "level"])
    w = h.groupBy("detector").pivot("level", ["run", "group"]).agg(F.max("chi2"))
    return w.select("detector", rnd("run").alias("run_chi2"), rnd("group").alias("group_chi2"),
                    rnd(F.try_divide("run", "group")).alias("ratio"))


Z_SQL = ("CASE WHEN (a.k+b.k)/(a.n+b.n) > 0 AND (a.k+b.k)/(a.n+b.n) < 1 THEN (a.k/a.n - b.k/b.n) / "
         "sqrt((a.k+b.k)/(a.n+b.n) * (1-(a.k+b.k)/(a.n+b.n)) * (1.0/a.n + 1.0/b.n)) END")


@query("comparator_matching", f"""{RUNS}, {LEVELS},
pooled AS (SELECT detector, level, sum(k) AS k, sum(n) AS n FROM lv GROUP BY 1, 2),
z AS (SELECT a.detector, a.level, {Z_SQL} AS z, {wilson_sql('a.k', 'a.n', -1)} AS lo, {wilson_sql('a.k', 'a.n', 1)} AS hi
  FROM pooled a JOIN pooled b ON b.level = a.level AND b.detector = 'latency' WHERE a.detector <> 'latency'),
zc AS (SELECT a.detector, a.level, {Z_SQL} AS z FROM lv a JOIN lv b ON b.level = a.level AND b.c = a.c AND b.detector = 'latency' WHERE a.detector <> 'latency')
SELECT z.detector, z.level, round(z, 6) AS z, round({normal_two_sided_sql('z')}, 8) AS p, coalesce(abs(z) <= {Z95}, TRUE) AS matched, round(lo, 9) AS lo95, round(hi, 9) AS hi95,
  (SELECT count(*) FROM zc WHERE zc.detector = z.detector AND zc.level = z.level AND abs(zc.z) > {Z95}) AS cells_failing FROM z""")
def comparator_matching(spark, sf_dir):
    """Each detector's false-alarm rate against the comparator's, pooled and by cell, over runs and groups."""
    lv = both_levels(spark, sf_dir)
    against = lv.where("detector = 'latency'").select("c", "level", F.col("k").alias("bk"), F.col("n").alias("bn"))
    paired = lv.where("detector <> 'latency'").join(against, ["c", "level"])
    cell_z = two_proportion_z("k", "n", "bk", "bn")
    g = paired.groupBy("detector", "level").agg(
        *[F.sum(x).alias(x) for x in ("k", "n", "bk", "bn")], F.count_if(F.abs(cell_z) > Z95).alias("cells_failing"))
    z = two_proportion_z("k", "n", "bk", "bn")
    return g.withColumn("zz", z).select(
        "detector", "level", rnd("zz").alias("z"), rnd(normal_two_sided(F.col("zz")), 8).alias("p"),
        F.coalesce(F.abs("zz") <= Z95, F.lit(True)).alias("matched"), rnd(wilson("k", "n", -1), 9).alias("lo95"),
        rnd(wilson("k", "n", 1), 9).alias("hi95"), "cells_failing")


PAIRED = GROUPS + """,
diff AS (SELECT a.c, a.arm, a.rep, a.detector, a.f - b.f AS x FROM g a JOIN g b USING (c, arm, rep) WHERE a.detector <> 'latency' AND b.detector = 'latency'),
fam AS (
  SELECT 'coarse' AS grid, detector, 'pooled' AS cell, x FROM diff WHERE c IN (0.25, 0.5) UNION ALL
  SELECT 'fine', detector, 'pooled', x FROM diff UNION ALL
  SELECT 'coarse', detector, CAST(c AS VARCHAR), x FROM diff WHERE c IN (0.25, 0.5) UNION ALL
  SELECT 'fine', detector, CAST(c AS VARCHAR), x FROM diff),
t AS (SELECT grid, detector, cell, count(*) AS n, avg(x) AS difference, stddev_samp(x) / sqrt(count(*)) AS se FROM fam GROUP BY 1, 2, 3),
p0 AS (SELECT *, CASE WHEN se > 0 THEN difference / se END AS z FROM t),
p1 AS (SELECT *, CASE WHEN se > 0 THEN """ + normal_two_sided_sql("z") + """ WHEN difference = 0 THEN 1.0 ELSE 0.0 END AS p FROM p0),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detector, cell, CASE WHEN cell = 'pooled' THEN grid END ORDER BY grid) AS rn FROM p1) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, grid, detector, cell) AS r, count(*) OVER () AS m FROM dedup),
adj AS (SELECT *, least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)) AS holm_p,
  least(1.0, min(m * p / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh_p FROM r)"""


def paired_differences(spark, sf_dir):
    g = group_rates(spark, sf_dir)
    base = g.where("detector = 'latency'").select(*GROUP, F.col("f").alias("b"))
    return g.where("detector <> 'latency'").join(base, GROUP).withColumn("x", F.col("f") - F.col("b"))


def paired_family(spark, sf_dir):
    """Pooled and per-coverage tests of a coarse grid and of the fine grid that contains it; shared cells once."""
    d = paired_differences(spark, sf_dir)
    grids = F.when(F.col("c").isin(0.25, 0.5), F.array(F.lit("coarse"), F.lit("fine"))).otherwise(F.array(F.lit("fine")))
    rows = d.withColumn("grid", F.explode(grids)).withColumn(
        "cell", F.explode(F.array(F.lit("pooled"), F.col("c").cast("string"))))
    tests = rows.groupBy("grid", "detector", "cell").agg(*[v.alias(k) for k, v in mean_test("x").items()])
    tests = tests.withColumn("p", F.when(F.col("se") > 0, normal_two_sided(F.col("z")))
                             .when(F.col("difference") == 0, 1.0).otherwise(0.0))
    # the family is a handful of tests; the first copy of a cell both grids hold is kept after they are seen to agree
    shared = F.when(F.col("cell") == "pooled", F.col("grid"))
    same = F.abs(F.max("difference") - F.min("difference")) < 1e-12
    first = lambda c: F.min_by(c, "grid").alias(c)
    return tests.groupBy("detector", "cell", shared.alias("_s")).agg(
        first("n"), first("difference"), first("se"), first("z"), first("lo95"), first("hi95"), first("p"),
        same.alias("copies_agree"), F.min("grid").alias("grid")).drop("_s")


@query("paired_tests", f"""{RUNS}, {PAIRED}
SELECT grid, detector, cell, n, round(difference, 9) AS difference, round(se, 9) AS se, round(p, 8) AS p,
  round(difference - {Z95} * se, 9) AS lo95, round(difference + {Z95} * se, 9) AS hi95, TRUE AS copies_agree FROM dedup""")
def paired_tests(spark, sf_dir):
    """Paired comparison of every detector with the comparator over independent groups."""
    f = paired_family(spark, sf_dir)
    return f.select("grid", "detector", "cell", "n", rnd("difference", 9).alias("difference"), rnd("se", 9).alias("se"),
                    rnd("p", 8).alias("p"), rnd("lo95", 9).alias("lo95"), rnd("hi95", 9).alias("hi95"), "copies_agree")


@query("multiplicity_adjustment", f"""{RUNS}, {PAIRED}
SELECT grid, detector, cell, round(p, 8) AS p, round(holm_p, 8) AS holm_p, round(bh_p, 8) AS bh_p,
  count(*) FILTER (WHERE holm_p <= 0.05) OVER () AS holm_survivors, count(*) FILTER (WHERE bh_p <= 0.05) OVER () AS bh_survivors FROM adj""")
def multiplicity_adjustment(spark, sf_dir):
    """Holm and Benjamini-Hochberg values over the enumerated family of tests, with survivor counts."""
    from pyspark.sql import Window as W
    fam = paired_family(spark, sf_dir).withColumn("family", F.lit("detectors"))
    adj = adjust_p(fam, ["family"], "p", ["grid", "detector", "cell"])
    w = W.partitionBy("family")
    return adj.select("grid", "detector", "cell", rnd("p", 8).alias("p"), rnd("holm_p", 8).alias("holm_p"), rnd("bh_p", 8).alias("bh_p"),
                      F.count_if(F.col("holm_p") <= 0.05).over(w).alias("holm_survivors"), F.count_if(F.col("bh_p") <= 0.05).over(w).alias("bh_survivors"))


@query("unpaired_interval", RUNS + """,
u AS (SELECT c, arm, rep, max(achieved_edge_frac) AS v FROM runs WHERE scen = 'control' GROUP BY 1, 2, 3),
s AS (SELECT c, avg(v) FILTER (WHERE arm = 'mnar') AS ma, avg(v) FILTER (WHERE arm = 'mcar') AS mb, var_samp(v) FILTER (WHERE arm = 'mnar') AS va,
  var_samp(v) FILTER (WHERE arm = 'mcar') AS vb, count(*) FILTER (WHERE arm = 'mnar') AS na, count(*) FILTER (WHERE arm = 'mcar') AS nb FROM u GROUP BY 1)
SELECT c, na, nb, round(ma - mb, 9) AS difference, round(sqrt(va/na + vb/nb), 9) AS se, round(ma - mb - 1.96*sqrt(va/na + vb/nb), 9) AS lo95,
  round(ma - mb + 1.96*sqrt(va/na + vb/nb), 9) AS hi95 FROM s""")
def unpaired_interval(spark, sf_dir):
    """Interval of a mean difference between arms that share no identifiers; copies must agree."""
    u = user_runs(spark, sf_dir).where("scen = 'control'").groupBy(*GROUP).agg(cells.strict_value("achieved_edge_frac").alias("v"))
    arm = lambda a: F.when(F.col("arm") == a, F.col("v"))
    s = u.groupBy("c").agg(F.count(arm("mnar")).alias("na"), F.count(arm("mcar")).alias("nb"),
                           (F.avg(arm("mnar")) - F.avg(arm("mcar"))).alias("d"),
                           F.sqrt(F.var_samp(arm("mnar")) / F.count(arm("mnar")) + F.var_samp(arm("mcar")) / F.count(arm("mcar"))).alias("e"))
    d, e = F.col("d"), F.col("e")
    return s.select("c", "na", "nb", rnd(d, 9).alias("difference"), rnd(e, 9).alias("se"), rnd(d - 1.96 * e, 9).alias("lo95"),
                    rnd(d + 1.96 * e, 9).alias("hi95"))


def rank_corr_sql(src: str, by: str, x: str, y: str) -> str:
    return f"""
rk AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0 AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
rho AS (SELECT {by}, count(*) AS n, CASE WHEN stddev_pop(rx) > 1e-12 AND stddev_pop(ry) > 1e-12 THEN corr(rx, ry) END AS rho FROM rk GROUP BY {by})"""


@query("rate_trend", f"""{RUNS}, {GROUPS},
cell AS (SELECT detector, c, round(avg(f), 9) AS r FROM g GROUP BY 1, 2),{rank_corr_sql('cell', 'detector', 'c', 'r')}
SELECT detector, n, round(rho, 9) AS rho FROM rho""")
def rate_trend(spark, sf_dir):
    """Rank correlation of the false-alarm rate with coverage; ties are judged at nine decimals, since a sum's order is free."""
    c = group_rates(spark, sf_dir).groupBy("detector", "c").agg(rnd(F.avg("f"), 9).alias("r"))
    return spearman(c, ["detector"], "c", "r").select("detector", "n", rnd("rho", 9).alias("rho"))


@query("spearman_by_flag", f"""WITH {rank_corr_sql('lineitem', 'l_returnflag', 'l_quantity', 'l_extendedprice')}
SELECT l_returnflag, n, round(rho, 9) AS rho FROM rho""")
def spearman_by_flag(spark, sf_dir):
    """Spearman correlation over millions of rows per group, ranked by counted values in range buckets."""
    li = T.table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    return spearman(li, ["l_returnflag"], "l_quantity", "l_extendedprice", buckets=256).select("l_returnflag", "n", rnd("rho", 9).alias("rho"))


@query("price_auc", """
WITH r AS (SELECT l_linestatus, l_returnflag, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice)
   + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS rk FROM lineitem),
s AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS n,
   sum(rk) FILTER (WHERE l_returnflag = 'R') AS rs FROM r GROUP BY 1)
SELECT l_linestatus, p AS n_pos, n AS n_neg, round((rs - p * (p + 1) / 2.0) / (1.0 * p * n), 9) AS auc FROM s""")
def price_auc(spark, sf_dir):
    """AUC over all order lines, ranked by counted values in range buckets."""
    from tidewatch.operators.inference import auc
    li = T.table(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice")
    out = auc(li, ["l_linestatus"], "l_extendedprice", F.col("l_returnflag") == "R", buckets=256)
    return out.select("l_linestatus", "n_pos", "n_neg", rnd("auc", 9).alias("auc"))


@query("guarded_correlation", f"""WITH {T.supplier_series_sql()},
s AS (SELECT run, scen, count(*) FILTER (WHERE form IS NOT NULL AND out IS NOT NULL) AS n, corr(form, out) AS r,
  stddev_pop(CASE WHEN out IS NOT NULL THEN form END) AS sx, stddev_pop(CASE WHEN form IS NOT NULL THEN out END) AS sy FROM series GROUP BY 1, 2)
SELECT run, scen, n, round(CASE WHEN n >= 4 AND sx >= 1e-12 AND sy >= 1e-12 THEN r END, 8) AS r FROM s""")
def guarded_correlation(spark, sf_dir):
    """Correlation of two measures of a run, undefined for few points or a constant side."""
    s = T.supplier_series(spark, sf_dir)
    both = F.col("form").isNotNull() & F.col("out").isNotNull()
    return s.groupBy("run", "scen").agg(F.count_if(both).alias("n"), rnd(guarded_corr("form", "out"), 8).alias("r"))


COLLAPSED = f"""
dl AS ({R.detectors_long_sql('runs', 'c, arm, rep, scen')}),
coll AS (SELECT c, arm, rep, scen, detector, avg(coalesce(t, 360)) AS cyc, bool_and(t IS NOT NULL) AS all_, bool_or(t IS NOT NULL) AS any_ FROM dl GROUP BY 1, 2, 3, 4, 5),
lead AS (SELECT x.c, x.arm, x.rep, x.detector, k.cyc - x.cyc AS gain, x.all_ AND k.all_ AS both_fired, x.any_ AS fired, x.cyc < k.cyc AS earlier,
    coalesce(xt.any_, FALSE) OR coalesce(kt.any_, FALSE) AS twin_alarmed
  FROM coll x JOIN coll k ON k.c = x.c AND k.arm = x.arm AND k.rep = x.rep AND k.scen = x.scen AND k.detector = 'latency'
  LEFT JOIN coll xt ON xt.c = x.c AND xt.arm = x.arm AND xt.rep = x.rep AND xt.scen = 'control' AND xt.detector = x.detector
  LEFT JOIN coll kt ON kt.c = x.c AND kt.arm = x.arm AND kt.rep = x.rep AND kt.scen = 'control' AND kt.detector = 'latency'
  WHERE x.scen = 'degrade' AND x.detector <> 'latency')"""


def comparator_leads(spark, sf_dir):
    """Per group and detector: lead over the comparator and whether the control twins stayed silent.

    Comparator and twin are columns of the same group, so one grouping replaces three lookups.
    """
    d = R.detectors_long(user_runs(spark, sf_dir), [*GROUP, "scen"])
    eff, fired = F.coalesce("t", F.lit(R.HALF_HOURS)).cast("double"), F.col("t").isNotNull()
    deg, ctl, aggs = F.col("scen") == "degrade", F.col("scen") == "control", []
    for x in DETECTORS:
        mine = F.col("detector") == x
        aggs += [F.avg(F.when(deg & mine, eff)).alias(f"cyc_{x}"), F.bool_and(F.when(deg & mine, fired)).alias(f"all_{x}"),
                 F.bool_or(F.when(deg & mine, fired)).alias(f"any_{x}"),
                 F.coalesce(F.bool_or(F.when(ctl & mine, fired)), F.lit(False)).alias(f"twin_{x}")]
    g = d.groupBy(*GROUP).agg(*aggs).where("cyc_latency IS NOT NULL")
    rows = F.explode(F.array(*[F.struct(
        F.lit(x).alias("detector"), (F.col("cyc_latency") - F.col(f"cyc_{x}")).alias("gain"),
        (F.col(f"all_{x}") & F.col("all_latency")).alias("both_fired"), F.col(f"any_{x}").alias("fired"),
        (F.col(f"cyc_{x}") < F.col("cyc_latency")).alias("earlier"),
        (F.col(f"twin_{x}") | F.col("twin_latency")).alias("twin_alarmed")) for x in DETECTORS if x != "latency"]))
    return g.select(*GROUP, rows.alias("r")).select(*GROUP, "r.*")


@query("comparator_lead", f"""{RUNS}, {COLLAPSED}
SELECT detector, count(*) AS n_groups, round(avg(gain), 9) AS censored_gain, count(*) FILTER (WHERE both_fired) AS n_both,
  round(avg(gain) FILTER (WHERE both_fired), 9) AS paired_gain, count(*) FILTER (WHERE both_fired AND NOT twin_alarmed) AS n_clean,
  round(avg(gain) FILTER (WHERE both_fired AND NOT twin_alarmed), 9) AS clean_gain, count(*) FILTER (WHERE fired) AS n_fired,
  count(*) FILTER (WHERE both_fired AND earlier) AS n_earlier FROM lead GROUP BY 1""")
def comparator_lead(spark, sf_dir):
    """Lead of every detector over the comparator: all groups, both fired, and with silent control twins."""
    b, clean = F.col("both_fired"), F.col("both_fired") & ~F.col("twin_alarmed")
    return comparator_leads(spark, sf_dir).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n_groups"), rnd(F.avg("gain"), 9).alias("censored_gain"), F.count_if(b).alias("n_both"),
        rnd(F.avg(F.when(b, F.col("gain"))), 9).alias("paired_gain"), F.count_if(clean).alias("n_clean"),
        rnd(F.avg(F.when(clean, F.col("gain"))), 9).alias("clean_gain"), F.count_if("fired").alias("n_fired"),
        F.count_if(b & F.col("earlier")).alias("n_earlier"))


@query("comparator_lead_by_coverage", f"""{RUNS}, {COLLAPSED}
SELECT c, detector, count(*) AS n_groups, round(avg(gain), 9) AS gain FROM lead GROUP BY 1, 2""")
def comparator_lead_by_coverage(spark, sf_dir):
    """The censored lead by coverage."""
    return comparator_leads(spark, sf_dir).groupBy("c", "detector").agg(
        F.count(F.lit(1)).alias("n_groups"), rnd(F.avg("gain"), 9).alias("gain"))


@query("mixture_selection")
def mixture_selection(spark, sf_dir):
    """One against two Gaussian components for each segment's customer balance, by BIC after EM from a median split."""
    c = T.table(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal", "c_custkey")
    out = mixture.two_component_bic(c, "c_mktsegment", "c_acctbal", tol=0.02)
    return out.select("c_mktsegment", "n", *[rnd(x, 4).alias(x) for x in (
        "bic_1", "bic_2", "delta_bic", "m1", "m2", "s1", "s2", "weight_1")], "two_component_preferred", "iterations")
