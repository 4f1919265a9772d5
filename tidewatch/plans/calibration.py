"""Queries that pick detection thresholds on null runs and measure them on the rest."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from tidewatch.functions.columns import combine_legs, null_safe_mean, rnd
from tidewatch.operators import alarms, rolling
from tidewatch.operators import calibrate as K
from tidewatch.operators.alarms import LaggingRule, LeadingRule, Rule
from tidewatch.operators.inference import auc
from tidewatch.plans import series as P
from tidewatch.plans.registry import query
from tidewatch.plans.series import COMBINE_SQL, RULE, RUN, RUNS, SCORED, STATS, SUP
from tidewatch.session import cut_lineage, shared_dir
from tidewatch.sources import store
from tidewatch.sources import tables as T

GRID = K.grid_values(0.0, 6.0, 0.25)
TARGET = 0.10
GRID_SQL = "grid AS (SELECT CAST(range * 0.25 AS DOUBLE) AS k FROM range(25))"
LEAD = SCORED + f",{P.lead_sql(RUN, RULE.leading)}"
CURVE = f"""{LEAD}, {GRID_SQL},
curve AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE sustained_score >= k) AS n_false FROM lead CROSS JOIN grid WHERE scen = 'control' GROUP BY 1)"""


def lead_rows(spark, sf_dir):
    return alarms.leading_alarm(P.supplier_scores(spark, sf_dir), RUN, RULE.leading)


def null_curve(spark, sf_dir):
    return K.fpr_curve(lead_rows(spark, sf_dir).where("scen = 'control'"), [], "sustained_score", GRID)


@query("fpr_curve", CURVE + " SELECT k, n, n_false, round(1.0 * n_false / n, 9) AS fpr FROM curve")
def fpr_curve(spark, sf_dir):
    """False-alarm rate of null runs over the whole threshold grid."""
    return null_curve(spark, sf_dir).select("k", "n", "n_false", rnd("fpr", 9).alias("fpr"))


@query("threshold_pick", CURVE + f"""
SELECT k, n_false, n, round(1.0 * n_false / n, 9) AS fpr FROM curve WHERE 1.0 * n_false / n <= {TARGET} ORDER BY k LIMIT 1""")
def threshold_pick(spark, sf_dir):
    """Smallest threshold whose null rate meets the target."""
    return K.smallest_admissible(null_curve(spark, sf_dir), [], TARGET).select("k", "n_false", "n", rnd("fpr", 9).alias("fpr"))


@query("count_matched_threshold", CURVE + """
SELECT k, n_false, round(1.0 * n_false / n, 9) AS fpr FROM curve ORDER BY abs(n_false - 7), k DESC LIMIT 1""")
def count_matched_threshold(spark, sf_dir):
    """Threshold whose number of false alarms is nearest a target count."""
    return K.count_matched(null_curve(spark, sf_dir), [], 7).select("k", "n_false", rnd("fpr", 9).alias("fpr"))


@query("null_quantiles", LEAD + """
SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS q, round(unnest(quantile_cont(sustained_score, [0.5, 0.9, 0.95, 0.99, 1.0])), 6) AS score FROM lead WHERE scen = 'control'""")
def null_quantiles(spark, sf_dir):
    """Quantiles of the null statistic."""
    qs = F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99, 1.0)])
    v = lead_rows(spark, sf_dir).where("scen = 'control'").agg(F.percentile("sustained_score", qs).alias("v"))
    return v.select(F.explode(F.arrays_zip(qs.alias("q"), F.col("v"))).alias("z")).select(
        F.col("z.q").alias("q"), rnd("z.v").alias("score"))


OBS = STATS + "," + P.z_sql("stats", RUN, 20, 60) + f""",
sc AS (SELECT run, scen, class, cycle, 0.5 * (z_var + z_ac) AS score FROM z),
fl AS (SELECT run, scen, class, CASE WHEN count(CASE WHEN cycle >= 60 THEN score END) OVER w = 3 THEN min(CASE WHEN cycle >= 60 THEN score END) OVER w END AS f
  FROM sc WINDOW w AS (PARTITION BY run, scen, class ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ob AS (SELECT class, run, max(f) AS s FROM fl WHERE scen = 'control' GROUP BY 1, 2), {GRID_SQL},
curve AS (SELECT class, k, count(*) AS n, count(*) FILTER (WHERE s >= k) AS n_false FROM ob CROSS JOIN grid GROUP BY 1, 2)"""


@query("observable_thresholds", OBS + f"""
SELECT class AS observable, min(k) AS k, max(n) AS n, arg_min(n_false, k) AS n_false, round(1.0 * arg_min(n_false, k) / max(n), 9) AS fpr
FROM curve WHERE 1.0 * n_false / n <= {TARGET} GROUP BY 1""")
def observable_thresholds(spark, sf_dir):
    """An own threshold for every watched class, in one job."""
    keys = [*RUN, "class"]
    z = rolling.baseline_z(P.supplier_stats(spark, sf_dir), RUN, 20, 60)
    fl = alarms.sustained_floor(z, keys, 0.5 * (F.col("z_var") + F.col("z_ac")), 3, 60, "f")
    s = fl.where("scen = 'control'").groupBy(F.col("class").alias("observable"), "run").agg(F.max("f").alias("s"))
    pick = K.smallest_admissible(K.fpr_curve(s, ["observable"], "s", GRID), ["observable"], TARGET, required=False)
    return pick.select("observable", "k", "n", "n_false", rnd("fpr", 9).alias("fpr"))


# ------------------------------------------------------------------ lagging comparator
KSD = K.grid_values(0.5, 4.0, 0.25)
KSD_SQL = "kgrid AS (SELECT CAST(0.5 + range * 0.25 AS DOUBLE) AS k FROM range(15))"
DROPS = f"WITH {SUP},{P.lag_sql('series', RUN, 'out', RULE.lagging)}, {KSD_SQL}," + ",".join(f"""
fl{s} AS (SELECT run, scen, {s} AS sustain, cycle, CASE WHEN count(CASE WHEN cycle >= 60 THEN drop_sd END) OVER w = {s} THEN min(CASE WHEN cycle >= 60 THEN drop_sd END) OVER w END AS f
  FROM drops WINDOW w AS (PARTITION BY run, scen ORDER BY cycle ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW))""" for s in (2, 3)) + """,
fl AS (SELECT * FROM fl2 UNION ALL SELECT * FROM fl3),
tops AS (SELECT run, scen, sustain, max(f) AS top FROM fl GROUP BY 1, 2, 3),
byrule AS (SELECT run, scen, sustain, k, min(cycle) AS alarm_cycle FROM fl JOIN kgrid ON f > k GROUP BY 1, 2, 3, 4)"""


def drop_floors(spark, sf_dir):
    """Sustained drops for both sustain lengths as rows ``(run, scen, sustain, cycle, f)``."""
    d = alarms.output_drop(T.supplier_series(spark, sf_dir), RUN, "out", RULE.lagging)
    for s in (2, 3):
        d = alarms.sustained_floor(d, RUN, F.col("drop"), s, RULE.lagging.baseline_end, f"f{s}")
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("sustain"), F.col(f"f{s}").alias("f")) for s in (2, 3)]))
    return d.select(*RUN, "cycle", both.alias("x")).select(*RUN, "cycle", "x.*")


@query("alarm_by_rule", DROPS + " SELECT run, scen, sustain, k AS k_sd, alarm_cycle FROM byrule WHERE scen = 'degrade'")
def alarm_by_rule(spark, sf_dir):
    """Alarm cycle of every run under every candidate rule it fires for."""
    fl = drop_floors(spark, sf_dir).where("scen = 'degrade'")
    return K.alarm_by_threshold(fl, [*RUN, "sustain"], "f", KSD, strict=True).select(
        *RUN, "sustain", F.col("k").alias("k_sd"), "alarm_cycle")


LAG_GRID = DROPS + """,
nulls AS (SELECT sustain, k, count(*) AS n_null, count(*) FILTER (WHERE top >= k) AS n_false FROM tops CROSS JOIN kgrid WHERE scen = 'control' GROUP BY 1, 2),
nd AS (SELECT count(DISTINCT run) AS n FROM tops WHERE scen = 'degrade'),
hits AS (SELECT sustain, k, count(*) AS n_hit, median(alarm_cycle) AS med FROM byrule WHERE scen = 'degrade' GROUP BY 1, 2),
lg AS (SELECT sustain, k, 1.0 * n_false / n_null AS fpr, coalesce(n_hit, 0) / nd.n AS detect, med FROM nulls LEFT JOIN hits USING (sustain, k) CROSS JOIN nd)"""


def lagging_grid_table(spark, sf_dir):
    """False-alarm rate, detection rate and median alarm of every candidate, from one pass over the series."""
    tops = K.lagging_levels(T.supplier_series(spark, sf_dir), RUN, "out", RULE.lagging, (2, 3), KSD)
    null = K.fpr_curve(tops.where("scen = 'control'"), ["sustain"], "top", KSD)
    n_deg = tops.where("scen = 'degrade'").groupBy("sustain").agg(F.count(F.lit(1)).alias("n_deg"))
    fired = tops.where("scen = 'degrade'").select("sustain", F.posexplode("reached").alias("_i", "alarm_cycle"))
    hits = fired.groupBy("sustain", F.get(F.array(*[F.lit(k) for k in KSD]), F.col("_i")).alias("k")).agg(
        F.count(F.lit(1)).alias("n_hit"), F.median("alarm_cycle").alias("median_t"))
    return null.join(hits, ["sustain", "k"], "left").join(n_deg, "sustain").withColumn(
        "detect_rate", F.coalesce("n_hit", F.lit(0)) / F.col("n_deg"))


@query("lagging_grid", LAG_GRID + " SELECT sustain, k AS k_sd, round(fpr, 9) AS fpr, round(detect, 9) AS detect_rate, med AS median_t FROM lg")
def lagging_grid(spark, sf_dir):
    """The candidate grid of the lagging comparator."""
    return lagging_grid_table(spark, sf_dir).select(
        "sustain", F.col("k").alias("k_sd"), rnd("fpr", 9).alias("fpr"), rnd("detect_rate", 9).alias("detect_rate"), "median_t")


LAG_PICK = LAG_GRID + """ SELECT sustain, k AS k_sd, round(fpr, 9) AS fpr, round(detect, 9) AS detect_rate, med AS median_t
FROM lg WHERE fpr <= 0.6 AND detect >= 0.4 AND med IS NOT NULL ORDER BY med, k LIMIT 1"""


@query("lagging_pick", LAG_PICK)
def lagging_pick(spark, sf_dir):
    """Earliest-detecting admissible comparator; of equals the smaller threshold."""
    return lagging_choice(spark, sf_dir).select(
        "sustain", F.col("k").alias("k_sd"), rnd("fpr", 9).alias("fpr"), rnd("detect_rate", 9).alias("detect_rate"), "median_t")


def lagging_choice(spark, sf_dir):
    ok = (F.col("fpr") <= 0.6) & (F.col("detect_rate") >= 0.4) & F.col("median_t").isNotNull()
    return lagging_grid_table(spark, sf_dir).where(ok).orderBy("median_t", "k").limit(1)


# ------------------------------------------------------------------ leading rule grid
WINDOWS, CLASS_SETS, SUSTAINS = (20, 30), {"both": ("form", "esc"), "form": ("form",)}, (3, 5)
V = ["window", "classes", "combine", "sustain"]


def variants_sql() -> str:
    parts = [f"WITH {SUP}"]
    union = []
    for w in WINDOWS:
        p = f"w{w}_"
        parts += [P.stats_sql("series", RUN, ("form", "esc"), w, p=p), P.z_sql(f"{p}stats", RUN, w, 60, p)]
        for name, cls in CLASS_SETS.items():
            inside = ", ".join(f"'{c}'" for c in cls)
            for h, e in COMBINE_SQL.items():
                union.append(f"""SELECT {w} AS "window", '{name}' AS classes, '{h}' AS combine, run, scen, cycle, {e} AS score FROM
  (SELECT run, scen, cycle, avg(z_var) AS z_var, avg(z_ac) AS z_ac FROM {p}z WHERE class IN ({inside}) GROUP BY 1, 2, 3)""")
    floors = " UNION ALL ".join(f"""SELECT "window", classes, combine, {s} AS sustain, run, scen, cycle, score,
  CASE WHEN count(CASE WHEN cycle >= 60 THEN score END) OVER w{s} = {s} THEN min(CASE WHEN cycle >= 60 THEN score END) OVER w{s} END AS f
  FROM v WINDOW w{s} AS (PARTITION BY "window", classes, combine, run, scen ORDER BY cycle ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)""" for s in SUSTAINS)
    parts += [f"\nv AS ({' UNION ALL '.join(union)})", f"\nvf AS ({floors})", "\n" + GRID_SQL, """
vs AS (SELECT "window", classes, combine, sustain, run, scen, max(f) AS top, max(CASE WHEN cycle >= 60 THEN score END) AS max_score FROM vf GROUP BY 1, 2, 3, 4, 5, 6)""", f"""
vk AS (SELECT "window", classes, combine, sustain, min(k) AS k, arg_min(fpr, k) AS fpr FROM (SELECT "window", classes, combine, sustain, k, avg(CASE WHEN top >= k THEN 1.0::DOUBLE ELSE 0 END) AS fpr
  FROM vs CROSS JOIN grid WHERE scen = 'control' GROUP BY 1, 2, 3, 4, 5) WHERE fpr <= {TARGET} GROUP BY 1, 2, 3, 4)""", """
va AS (SELECT "window", classes, combine, sustain, run, min(CASE WHEN f >= k THEN cycle END) AS t FROM vf JOIN vk USING ("window", classes, combine, sustain) WHERE scen = 'degrade' GROUP BY 1, 2, 3, 4, 5)""", """
vr AS (SELECT "window", classes, combine, sustain, scen, rank() OVER w + (count(*) OVER (PARTITION BY "window", classes, combine, sustain, max_score) - 1) / 2.0 AS rk
  FROM vs WHERE max_score IS NOT NULL WINDOW w AS (PARTITION BY "window", classes, combine, sustain ORDER BY max_score))""", """
vauc AS (SELECT "window", classes, combine, sustain, ((sum(rk) FILTER (WHERE scen = 'degrade')) - np * (np + 1) / 2.0) / (1.0 * np * nn) AS auc
  FROM (SELECT *, count(*) FILTER (WHERE scen = 'degrade') OVER w2 AS np, count(*) FILTER (WHERE scen = 'control') OVER w2 AS nn FROM vr WINDOW w2 AS (PARTITION BY "window", classes, combine, sustain))
  GROUP BY 1, 2, 3, 4, np, nn)"""]
    return ",".join(parts)


SEARCH = variants_sql() + """
SELECT "window", classes, combine, sustain, k, round(fpr, 9) AS fpr, round(avg(CASE WHEN t IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS detect_rate,
  median(t) AS median_t, 150 - median(t) AS median_lead, round(any_value(auc), 9) AS auc
FROM va JOIN vk USING ("window", classes, combine, sustain) JOIN vauc USING ("window", classes, combine, sustain) GROUP BY 1, 2, 3, 4, 5, fpr"""


@query("leading_grid_search", SEARCH)
def leading_grid_search(spark, sf_dir):
    """Every variant of the leading rule at its smallest admissible threshold, with detection, lead and AUC. Variants without
    an admissible threshold are left out."""
    return search_table(spark, sf_dir).withColumn("median_lead", 150 - F.col("median_t"))


def search_table(spark, sf_dir):
    """All variants from one materialised table with a row for each variant and run, which the thresholds, the detections and the
    AUC share."""
    runs = cut_lineage(K.leading_levels(T.supplier_series(spark, sf_dir), RUN, WINDOWS, CLASS_SETS, list(COMBINE_SQL), SUSTAINS, 60, GRID))
    pick = K.smallest_admissible(K.fpr_curve(runs.where("scen = 'control'"), V, "top", GRID), V, TARGET, required=False)
    at = F.array_position(F.array(*[F.lit(k) for k in GRID]), F.col("k")) - 1
    hit = runs.where("scen = 'degrade'").join(F.broadcast(pick.select(*V, "k", "fpr")), V).withColumn("t", F.get("reached", at.cast("int")))
    table = hit.groupBy(*V, "k", "fpr").agg((F.count("t") / F.count(F.lit(1))).alias("detect_rate"), F.median("t").alias("median_t"))
    a = auc(runs, V, "most", F.col("scen") == "degrade", buckets=256).select(*V, "auc")
    return table.join(a, V).select(*V, "k", rnd("fpr", 9).alias("fpr"), rnd("detect_rate", 9).alias("detect_rate"), "median_t",
                                   rnd("auc", 9).alias("auc"))


# least share of transitions that a chosen rule has to detect; the given tables hold no true transition, so it is low
DETECT = 0.05
LEAD_PICK = f"""WITH s AS ({SEARCH}), l AS ({LAG_PICK})
SELECT s.* EXCLUDE (median_lead), l.median_t - s.median_t AS median_lead, l.k_sd, l.sustain AS lag_sustain FROM s, l
WHERE s.detect_rate >= {DETECT} AND s.median_t IS NOT NULL ORDER BY median_lead DESC, auc DESC, "window", classes, combine, sustain LIMIT 1"""


def leading_choice(spark, sf_dir):
    """The variant with the longest median lead on the chosen comparator, then the largest AUC; ties in the order of the grid."""
    lag = lagging_choice(spark, sf_dir).select(F.col("k").alias("k_sd"), F.col("sustain").alias("lag_sustain"), F.col("median_t").alias("_lag_t"))
    ok = search_table(spark, sf_dir).where((F.col("detect_rate") >= DETECT) & F.col("median_t").isNotNull())
    ranked = ok.join(lag, F.lit(True)).withColumn("median_lead", F.col("_lag_t") - F.col("median_t"))  # one comparator row
    return ranked.orderBy(F.desc("median_lead"), F.desc("auc"), *V).limit(1).drop("_lag_t")


@query("leading_pick", LEAD_PICK)
def leading_pick(spark, sf_dir):
    """The admissible variant of the leading rule that leads the comparator most, with the comparator it was chosen against."""
    return leading_choice(spark, sf_dir)


@query("calibrated_rule", f"""WITH p AS ({LEAD_PICK})
SELECT "window", classes, combine, sustain, k AS stored_k, k AS selected_k, k_sd AS stored_k_sd, k_sd AS selected_k_sd, lag_sustain,
  k = {RULE.leading.k} AND "window" = {RULE.leading.window} AS is_default FROM p""")
def calibrated_rule(spark, sf_dir):
    """The rule that calibration chooses, both sides, written once as a rule file, read back, and selected anew from it.

    The second selection scores the runs by the stored rule itself, not by the floors of the search.
    """
    chosen = leading_choice(spark, sf_dir).first()
    schema = ('"window" int, classes string, combine string, sustain int, stored_k double, selected_k double, stored_k_sd double, '
              "selected_k_sd double, lag_sustain int, is_default boolean").replace('"', "`")
    if chosen is None:  # no variant is admissible on these data
        return spark.createDataFrame([], schema)
    leading = dict(asdict(RULE.leading), window=chosen["window"], classes=CLASS_SETS[chosen["classes"]], combine=chosen["combine"],
                   sustain=chosen["sustain"], k=chosen["k"])
    lagging = dict(asdict(RULE.lagging), k_sd=chosen["k_sd"], sustain=chosen["lag_sustain"])
    path = f"{shared_dir(spark)}/rule-{uuid.uuid4().hex}"
    store.write_rule(spark, Rule(LeadingRule(**leading), LaggingRule(**lagging)), path)
    rule = store.load_rule(spark, path)
    scores = alarms.leading_alarm(P.supplier_scores(spark, sf_dir, rule.leading), RUN, rule.leading)
    lead = K.smallest_admissible(K.fpr_curve(scores.where("scen = 'control'"), [], "sustained_score", GRID), [], TARGET)
    lag = lagging_choice(spark, sf_dir).where(F.col("sustain") == rule.lagging.sustain)
    classes = next(name for name, cls in CLASS_SETS.items() if cls == rule.leading.classes)
    return lead.join(lag.select(F.col("k").alias("selected_k_sd")), F.lit(True)).select(
        F.lit(rule.leading.window).alias("window"), F.lit(classes).alias("classes"), F.lit(rule.leading.combine).alias("combine"),
        F.lit(rule.leading.sustain).alias("sustain"), F.lit(float(rule.leading.k)).alias("stored_k"), F.col("k").alias("selected_k"),
        F.lit(float(rule.lagging.k_sd)).alias("stored_k_sd"), "selected_k_sd", F.lit(rule.lagging.sustain).alias("lag_sustain"),
        F.lit(rule.leading.k == RULE.leading.k and rule.leading.window == RULE.leading.window).alias("is_default"))


THR = [0.2, 0.3, 0.4, 0.5]
TREND_GRID = STATS + "," + P.tau_sql(15, 9) + """,
tg AS (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS thr),
tc AS (SELECT run, scen, cycle, 'and' AS combine, CASE WHEN tau_var IS NOT NULL AND tau_ac IS NOT NULL THEN least(tau_var, tau_ac) END AS s FROM trends UNION ALL
  SELECT run, scen, cycle, 'var_only', tau_var FROM trends),
tf AS (SELECT run, scen, combine, cycle, CASE WHEN count(s) OVER w = 3 THEN min(s) OVER w END AS f FROM tc WINDOW w AS (PARTITION BY run, scen, combine ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ta AS (SELECT run, scen, combine, thr, min(CASE WHEN f >= thr THEN cycle END) AS t FROM tf CROSS JOIN tg GROUP BY 1, 2, 3, 4)"""


@query("trend_grid", TREND_GRID + """
SELECT combine, thr, round(avg(CASE WHEN t IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE scen = 'control'), 9) AS fpr,
  round(avg(CASE WHEN t IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE scen = 'degrade'), 9) AS detect_rate, median(t) FILTER (WHERE scen = 'degrade') AS median_t FROM ta GROUP BY 1, 2""")
def trend_grid(spark, sf_dir):
    """The same grid for the trend rule."""
    t = P.mixed_trends(spark, sf_dir)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("combine"), combine_legs(F.col("tau_var"), F.col("tau_ac"), h).alias("s"))
                               for h in ("and", "var_only")]))
    s = t.select(*RUN, "cycle", rows.alias("r")).select(*RUN, "cycle", "r.*")
    keys = ["combine", *RUN]
    fl = alarms.sustained_floor(s, keys, F.col("s"), 3, 0, "f")
    n = fl.groupBy(*keys).agg(F.max("f").alias("top"))
    sizes = n.groupBy("combine").agg(F.count_if(F.col("scen") == "control").alias("nc"), F.count_if(F.col("scen") == "degrade").alias("nd"))
    deg = F.when(F.col("scen") == "degrade", F.col("alarm_cycle"))
    fired = K.alarm_by_threshold(fl, keys, "f", THR).groupBy("combine", "k").agg(
        F.count_if(F.col("scen") == "control").alias("fc"), F.count(deg).alias("fd"), F.median(deg).alias("median_t"))
    full = sizes.withColumn("k", F.explode(F.array(*[F.lit(x) for x in THR]))).join(fired, ["combine", "k"], "left")
    share = lambda a, b: rnd(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 9)
    return full.select("combine", F.col("k").alias("thr"), share("fc", "nc").alias("fpr"), share("fd", "nd").alias("detect_rate"), "median_t")


@query("two_rules", f"""{RUNS},{P.score_sql('series', RUN, RULE.with_leading(classes=('form',)).leading, 'f_')},{P.lead_sql(RUN, RULE.with_leading(classes=('form',)).leading, 'f_')}
SELECT s.run, s.scen, s.t_lead, s.dt_censored, f.t_lead AS bc_t_lead, coalesce(s.t_lag, 179) - coalesce(f.t_lead, 179) AS bc_dt_censored
FROM scored_runs s JOIN f_lead f USING (run, scen)""")
def two_rules(spark, sf_dir):
    """The same runs scored under two declared rules side by side."""
    one = P.supplier_runs(spark, sf_dir)
    rule = RULE.with_leading(classes=("form",)).leading
    two = alarms.leading_alarm(P.supplier_scores(spark, sf_dir, rule), RUN, rule).select(*RUN, F.col("t_lead").alias("bc_t_lead"))
    n = F.lit(T.SHIP_CYCLES)
    return one.join(two, RUN).select(*RUN, "t_lead", "dt_censored", "bc_t_lead",
                                     (F.coalesce("t_lag", n) - F.coalesce("bc_t_lead", n)).alias("bc_dt_censored"))


@query("chosen_rule", CURVE + f"""
SELECT 'mean' AS combine, 20 AS "window", 3 AS sustain, k, n_false, n AS n_null, round(1.0 * n_false / n, 9) AS calibration_fpr, {TARGET}::DOUBLE AS nominal_fpr_target
FROM curve WHERE 1.0 * n_false / n <= {TARGET} ORDER BY k LIMIT 1""")
def chosen_rule(spark, sf_dir):
    """The declared rule with its calibrated threshold and the evidence for it, as one row."""
    r = RULE.leading
    pick = K.smallest_admissible(null_curve(spark, sf_dir), [], TARGET)
    return pick.select(F.lit(r.combine).alias("combine"), F.lit(r.window).alias("window"), F.lit(r.sustain).alias("sustain"), "k", "n_false",
                       F.col("n").alias("n_null"), rnd("fpr", 9).alias("calibration_fpr"), F.lit(TARGET).alias("nominal_fpr_target"))


# ------------------------------------------------------------------ detrending and window variants
VAR_W = (20, 30, 45)


def _variant_parts():
    parts, union = [f"WITH {SUP}"], []
    for w in VAR_W:
        p = f"l{w}_"
        parts += [P.stats_sql("series", RUN, ("form",), w, p=p), P.z_sql(f"{p}stats", RUN, w, 60, p)]
        union.append(f"SELECT 'linear_w{w}' AS variant, run, scen, cycle, z_var, z_ac FROM {p}z")
    parts += [P.KERNEL.split("WITH ", 1)[1].split(SUP + ",", 1)[1]]
    for w in VAR_W:
        p = f"g{w}_"
        need = max(4, -(-w // 2))
        parts += [P.rolling_sql("residual", RUN, w, need, "aa", "bb", "ab", "syy / (k - 1)", p), P.z_sql(f"{p}stats", RUN, w, 60, p)]
        union.append(f"SELECT 'gauss_w{w}', run, scen, cycle, z_var, z_ac FROM {p}z")
    parts.append(f"\nallz AS ({' UNION ALL '.join(union)})")
    return ",".join(parts)


@query("score_variants", _variant_parts() + """
SELECT variant, run, scen, count(s) AS n_scored, round(max(s) FILTER (WHERE cycle >= 60), 6) AS max_score
FROM (SELECT variant, run, scen, cycle, CASE WHEN z_var IS NULL THEN z_ac WHEN z_ac IS NULL THEN z_var ELSE (z_var + z_ac) / 2 END AS s FROM allz) GROUP BY 1, 2, 3""")
def score_variants(spark, sf_dir):
    """The score under linear and kernel detrending at three windows; the mean runs over all defined z values."""
    filled = rolling.fill_gaps(rolling.unpivot_classes(T.supplier_series(spark, sf_dir), RUN, ("form",)), [*RUN, "class"])
    series = cut_lineage(rolling.kernel_residual(filled, [*RUN, "class"]))  # read by six variants
    out = None
    for w in VAR_W:
        for mode in ("linear", "gauss"):
            st = rolling.rolling_var_ac(series, [*RUN, "class"], y="y" if mode == "linear" else "r", window=w, detrend=mode == "linear")
            z = rolling.baseline_z(st.select(*RUN, "class", "cycle", "var", "ac"), RUN, w, 60)
            s = z.withColumn("s", null_safe_mean([F.col("z_var"), F.col("z_ac")]))  # of the one class
            one = s.groupBy(*RUN).agg(F.count("s").alias("n_scored"), rnd(F.max(F.when(F.col("cycle") >= 60, F.col("s")))).alias("max_score")).withColumn("variant", F.lit(f"{mode}_w{w}"))
            out = one if out is None else out.unionByName(one)
    return out
