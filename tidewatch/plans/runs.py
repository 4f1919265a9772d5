"""Queries over per-run rows: derived columns, keys, cell summaries, joins between campaigns, selections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions import columns as C
from tidewatch.functions.columns import rnd
from tidewatch.functions.intervals import Z80, Z95, rate, wilson, wilson_sql
from tidewatch.operators import cells
from tidewatch.operators.inference import auc
from tidewatch.plans.registry import query
from tidewatch.sources import runs as R
from tidewatch.sources.runs import DESIGN, DETECTORS, GROUP, user_runs

RUNS = f"WITH {R.user_runs_sql()}"
BOTH = f"WITH {R.user_runs_sql()},{R.first_campaign_sql()}"


@query("run_rows", RUNS + """
SELECT c, arm, colour, sev, scen, rep, seed, t_lead, t_lag, dt_censored, dt_paired, lead_fired, lag_fired,
  lead_max_score, round(achieved_edge_frac, 9) AS achieved_edge_frac, obs_events FROM runs""")
def run_rows(spark, sf_dir):
    """The per-run table with censored and paired lead times."""
    return user_runs(spark, sf_dir).select(
        *DESIGN, "seed", "t_lead", "t_lag", "dt_censored", "dt_paired", "lead_fired", "lag_fired", "lead_max_score",
        rnd("achieved_edge_frac", 9).alias("achieved_edge_frac"), "obs_events")


@query("cell_filter", RUNS + """
SELECT rep, seed, t_lead, t_lag FROM runs WHERE arm = 'mnar' AND colour = 'white' AND c = 0.5 AND scen = 'degrade'""")
def cell_filter(spark, sf_dir):
    """One design cell by conjunctive equality."""
    cell = {"arm": "mnar", "colour": "white", "c": 0.5, "scen": "degrade"}
    df = user_runs(spark, sf_dir)
    for name, value in cell.items():
        df = df.where(F.col(name) == value)
    return df.select("rep", "seed", "t_lead", "t_lag")


PATTERN_SQL = """CASE WHEN t_lead IS NOT NULL AND t_lag IS NOT NULL THEN 'both_fired' WHEN t_lead IS NOT NULL THEN 'lead_only'
  WHEN t_lag IS NOT NULL THEN 'lag_only' ELSE 'neither' END"""


@query("firing_patterns", RUNS + f"""
SELECT c, arm, scen, {PATTERN_SQL} AS pattern, count(*) AS n FROM runs GROUP BY 1, 2, 3, 4""")
def firing_patterns(spark, sf_dir):
    """How often both, one or neither detector fired."""
    return (user_runs(spark, sf_dir).groupBy("c", "arm", "scen", C.firing_pattern("t_lead", "t_lag").alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("stable_keys", """
SELECT user_id, CAST(CAST('0x' || substr(sha256('users|' || user_id), 1, 12) AS BIGINT) % 900000 AS BIGINT) AS seed,
  41012 + CAST('0x' || substr(sha256('floor|' || user_id), 1, 8) AS BIGINT) % 1000000 AS cell_seed,
  CASE WHEN user_id % 2 = 0 THEN 'mnar' ELSE 'mcar' END || '|' || (user_id % 3) AS cell_key, count(*) AS n
FROM events GROUP BY user_id""")
def stable_keys(spark, sf_dir):
    """Reproducible integer keys from text, in the six-byte and the four-byte-plus-offset form, and a composite key."""
    u = F.col("user_id")
    return (
        R.table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", C.stable_key(F.lit("users"), u).alias("seed"),
                C.stable_key(F.lit("floor"), u, hex_digits=8, modulus=1000000, offset=41012).alias("cell_seed"),
                F.concat_ws("|", F.when(u % 2 == 0, "mnar").otherwise("mcar"), (u % 3).cast("string")).alias("cell_key"),
                "n"))


@query("parity_split", RUNS + """
SELECT seed % 2 AS block, scen, count(*) AS n, count(*) FILTER (WHERE lead_fired) AS n_fired,
  round(avg(CASE WHEN lead_fired THEN 1.0::DOUBLE ELSE 0 END), 9) AS rate FROM runs GROUP BY 1, 2""")
def parity_split(spark, sf_dir):
    """Disjoint calibration and evaluation blocks by parity of the seed."""
    return user_runs(spark, sf_dir).groupBy(F.pmod("seed", F.lit(2)).alias("block"), "scen").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lead_fired").alias("n_fired"), rnd(rate("lead_fired"), 9).alias("rate"))


@query("detectors_long", RUNS + f""", d AS ({R.detectors_long_sql('runs', 'c, arm, scen, colour, rep')})
SELECT scen, colour, detector, count(*) AS n, count(t) AS n_fired, min(t) AS first_alarm, median(t) AS median_alarm
FROM d GROUP BY 1, 2, 3""")
def detectors_long(spark, sf_dir):
    """Wide detector columns to rows, summarised."""
    d = R.detectors_long(user_runs(spark, sf_dir), ["c", "arm", "scen", "colour", "rep"])
    return d.groupBy("scen", "colour", "detector").agg(
        F.count(F.lit(1)).alias("n"), F.count("t").alias("n_fired"), F.min("t").alias("first_alarm"),
        F.median("t").alias("median_alarm"))


@query("experiment_grid", RUNS + """,
grid AS (
  SELECT c, arm, colour, scen, unnest(range(0, CAST(top + 1 AS BIGINT))) AS rep FROM (SELECT c, max(rep) AS top FROM runs GROUP BY 1), (SELECT unnest(['mnar', 'mcar']) AS arm),
    (SELECT unnest(['white', 'red', 'systematic']) AS colour), (SELECT unnest(['degrade', 'control']) AS scen))
SELECT g.c, g.arm, count(*) AS n_declared, count(r.seed) AS n_present
FROM grid g LEFT JOIN runs r USING (c, arm, colour, scen, rep) GROUP BY 1, 2""")
def experiment_grid(spark, sf_dir):
    """The design with each coverage's own number of replicates, and which of its cells the data fills."""
    runs = user_runs(spark, sf_dir)
    arrays = {"c": R.COVERAGES, "arm": ("mnar", "mcar"), "colour": R.COLOURS, "scen": ("degrade", "control")}
    grid = spark.range(1)
    for name, levels in arrays.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    tops = runs.groupBy("c").agg(F.max("rep").alias("top"))
    grid = grid.join(tops, "c").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top").cast("bigint")))).drop("id", "top")
    return grid.join(runs, ["c", "arm", "colour", "scen", "rep"], "left").groupBy("c", "arm").agg(
        F.count(F.lit(1)).alias("n_declared"), F.count("seed").alias("n_present"))


@query("selector_lookup", RUNS + """
SELECT count(*) AS matches, max(t_lag) AS value FROM runs
WHERE c = 0.5 AND arm = 'mnar' AND colour = 'white' AND scen = 'degrade' AND rep = 3""")
def selector_lookup(spark, sf_dir):
    """A quoted value found by a field selector that has to match exactly one row."""
    sel = (F.col("c") == 0.5) & (F.col("arm") == "mnar") & (F.col("colour") == "white") & (F.col("scen") == "degrade")
    return user_runs(spark, sf_dir).where(sel & (F.col("rep") == 3)).agg(
        F.count(F.lit(1)).alias("matches"), F.max("t_lag").alias("value"))


@query("cell_summary", RUNS + """
SELECT c, arm, colour, sev, count(*) FILTER (WHERE scen = 'degrade') AS n_degrade, count(*) FILTER (WHERE scen = 'control') AS n_control,
  round(avg(dt_censored) FILTER (WHERE scen = 'degrade'), 9) AS dt_mean, round(avg(dt_paired) FILTER (WHERE scen = 'degrade'), 9) AS dt_paired_mean,
  count(dt_paired) FILTER (WHERE scen = 'degrade') AS dt_paired_n,
  round(avg(lead_fired::INT) FILTER (WHERE scen = 'degrade'), 9) AS lead_detect_rate,
  round(avg(lag_fired::INT) FILTER (WHERE scen = 'degrade'), 9) AS lag_detect_rate,
  median(t_lead) FILTER (WHERE scen = 'degrade') AS lead_median_t, median(t_lag) FILTER (WHERE scen = 'degrade') AS lag_median_t,
  round(avg(lead_fired::INT) FILTER (WHERE scen = 'control'), 9) AS fpr_leading,
  round(avg(lag_fired::INT) FILTER (WHERE scen = 'control'), 9) AS fpr_lagging,
  round(avg(achieved_edge_frac) FILTER (WHERE scen = 'degrade'), 9) AS achieved_mean,
  round(avg(achieved_edge_frac) FILTER (WHERE scen = 'degrade') / c, 9) AS achieved_over_nominal
FROM runs GROUP BY c, arm, colour, sev""")
def cell_summary(spark, sf_dir):
    """Degradation and control side by side for every design cell, from one grouping."""
    deg, ctl = F.col("scen") == "degrade", F.col("scen") == "control"
    d = lambda c: F.when(deg, F.col(c).cast("double"))
    k = lambda c: F.when(ctl, F.col(c).cast("double"))
    return user_runs(spark, sf_dir).groupBy("c", "arm", "colour", "sev").agg(
        F.count_if(deg).alias("n_degrade"), F.count_if(ctl).alias("n_control"),
        rnd(F.avg(d("dt_censored")), 9).alias("dt_mean"), rnd(F.avg(d("dt_paired")), 9).alias("dt_paired_mean"),
        F.count(d("dt_paired")).alias("dt_paired_n"),
        rnd(F.avg(d("lead_fired")), 9).alias("lead_detect_rate"), rnd(F.avg(d("lag_fired")), 9).alias("lag_detect_rate"),
        F.median(d("t_lead")).alias("lead_median_t"), F.median(d("t_lag")).alias("lag_median_t"),
        rnd(F.avg(k("lead_fired")), 9).alias("fpr_leading"), rnd(F.avg(k("lag_fired")), 9).alias("fpr_lagging"),
        rnd(F.avg(d("achieved_edge_frac")), 9).alias("achieved_mean"),
        rnd(F.avg(d("achieved_edge_frac")) / F.col("c"), 9).alias("achieved_over_nominal"))


@query("pooled_false_alarms", RUNS + """
SELECT colour, c, count(*) AS n, round(avg(lead_fired::INT), 9) AS fpr_leading, round(avg(lag_fired::INT), 9) AS fpr_lagging,
  avg(lead_fired::INT) <= 0.036 AS meets_bar
FROM runs WHERE scen = 'control' GROUP BY GROUPING SETS ((), (colour), (c))""")
def pooled_false_alarms(spark, sf_dir):
    """False-alarm rates pooled, by colour and by coverage in one pass."""
    ctl = user_runs(spark, sf_dir).where("scen = 'control'")
    return ctl.groupingSets([[], [F.col("colour")], [F.col("c")]], F.col("colour"), F.col("c")).agg(
        F.count(F.lit(1)).alias("n"), rnd(rate("lead_fired"), 9).alias("fpr_leading"),
        rnd(rate("lag_fired"), 9).alias("fpr_lagging"), (rate("lead_fired") <= 0.036).alias("meets_bar"))


@query("false_alarm_spread", RUNS + """,
cells AS (SELECT c, arm, colour, avg(lead_fired::INT) AS fpr FROM runs WHERE scen = 'control' GROUP BY 1, 2, 3)
SELECT count(*) AS n_cells, round(min(fpr), 9) AS fpr_min, round(median(fpr), 9) AS fpr_median, round(max(fpr), 9) AS fpr_max FROM cells""")
def false_alarm_spread(spark, sf_dir):
    """Smallest, median and largest cell false-alarm rate."""
    c = user_runs(spark, sf_dir).where("scen = 'control'").groupBy("c", "arm", "colour").agg(rate("lead_fired").alias("fpr"))
    return c.agg(F.count(F.lit(1)).alias("n_cells"), rnd(F.min("fpr"), 9).alias("fpr_min"),
                 rnd(F.median("fpr"), 9).alias("fpr_median"), rnd(F.max("fpr"), 9).alias("fpr_max"))


@query("cell_auc", RUNS + """,
r AS (SELECT c, arm, scen, lead_max_score, rank() OVER (PARTITION BY c, arm ORDER BY lead_max_score)
        + (count(*) OVER (PARTITION BY c, arm, lead_max_score) - 1) / 2.0 AS rk FROM runs WHERE lead_max_score IS NOT NULL)
SELECT c, arm, count(*) FILTER (WHERE scen = 'degrade') AS n_pos, count(*) FILTER (WHERE scen = 'control') AS n_neg,
  round(((sum(rk) FILTER (WHERE scen = 'degrade')) - count(*) FILTER (WHERE scen = 'degrade') * (count(*) FILTER (WHERE scen = 'degrade') + 1) / 2.0)
   / (count(*) FILTER (WHERE scen = 'degrade') * count(*) FILTER (WHERE scen = 'control')), 9) AS auc
FROM r GROUP BY 1, 2""")
def cell_auc(spark, sf_dir):
    """Discrimination of degradation from control runs by maximum score, per coverage and arm."""
    out = auc(user_runs(spark, sf_dir), ["c", "arm"], "lead_max_score", F.col("scen") == "degrade")
    return out.select("c", "arm", "n_pos", "n_neg", rnd("auc", 9).alias("auc"))


@query("label_auc", """
WITH d AS (SELECT lang, n_chars, quality FROM labels JOIN documents USING (doc_id)),
r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM d)
SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
  round(CASE WHEN min(quality) < max(quality) THEN ((sum(rk) FILTER (WHERE quality = 1)) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0)
   / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)) END, 9) AS auc
FROM r GROUP BY 1""")
def label_auc(spark, sf_dir):
    """The same statistic for binary labels scored by document length."""
    d = R.table(spark, sf_dir, "labels", "doc_id", "quality").join(
        R.table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    out = auc(d, ["lang"], "n_chars", F.col("quality") == 1)
    return out.select("lang", "n_pos", "n_neg", rnd("auc", 9).alias("auc"))


@query("collapse_copies", RUNS + """
SELECT c, arm, rep, count(*) AS size, round(avg(lead_fired::INT), 9) AS lead_fraction, bool_or(lead_fired) AS lead_any,
  bool_and(lead_fired) AS lead_all, round(avg(lag_fired::INT), 9) AS lag_fraction, max(achieved_edge_frac) = min(achieved_edge_frac) AS copies_agree,
  round(max(achieved_edge_frac), 9) AS achieved_edge_frac
FROM runs WHERE scen = 'control' GROUP BY 1, 2, 3""")
def collapse_copies(spark, sf_dir):
    """Copies that share a seed reduced to one independent row; a strict measure must agree between copies."""
    ctl = user_runs(spark, sf_dir).where("scen = 'control'")
    g = ctl.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("size"), rnd(rate("lead_fired"), 9).alias("lead_fraction"),
        F.bool_or("lead_fired").alias("lead_any"), F.bool_and("lead_fired").alias("lead_all"),
        rnd(rate("lag_fired"), 9).alias("lag_fraction"),
        (F.max("achieved_edge_frac") == F.min("achieved_edge_frac")).alias("copies_agree"),
        rnd(cells.strict_value("achieved_edge_frac"), 9).alias("achieved_edge_frac"))
    return g


@query("group_invariance", RUNS + f""", d AS ({R.detectors_long_sql("(SELECT * FROM runs WHERE scen = 'degrade')", 'c, arm, rep')}),
g AS (SELECT c, arm, rep, detector, count(DISTINCT coalesce(t, 360)) = 1 AS same FROM d GROUP BY 1, 2, 3, 4)
SELECT detector, count(*) AS n_groups, count(*) FILTER (WHERE same) AS invariant_groups FROM g GROUP BY 1""")
def group_invariance(spark, sf_dir):
    """Groups whose copies all give the same censored alarm cycle."""
    d = R.detectors_long(user_runs(spark, sf_dir).where("scen = 'degrade'"), GROUP)
    eff = F.coalesce("t", F.lit(R.HALF_HOURS))
    g = d.groupBy(*GROUP, "detector").agg((F.min(eff) == F.max(eff)).alias("same"))
    return g.groupBy("detector").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("same").alias("invariant_groups"))


@query("collapse_rules", f"""WITH {R.ORDER_RUNS_SQL},
g AS (SELECT grp, count(*) AS size, avg(lead_fired::INT) AS fr, bool_or(lead_fired) AS any_, bool_and(lead_fired) AS all_ FROM order_runs GROUP BY 1)
SELECT count(*) AS n_groups, count(*) FILTER (WHERE any_) AS any_rule, count(*) FILTER (WHERE fr > 0.5) AS majority_rule,
  count(*) FILTER (WHERE all_) AS all_rule, count(*) FILTER (WHERE any_ AND NOT all_) AS disagree, round(avg(fr), 9) AS mean_fraction FROM g""")
def collapse_rules(spark, sf_dir):
    """Any, majority and all rules for reducing a group to one verdict, and how many groups disagree inside."""
    g = cells.collapse_copies(R.order_runs(spark, sf_dir), ["grp"], ["lead_fired"])
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("lead_fired_any").alias("any_rule"),
                 F.count_if("lead_fired_majority").alias("majority_rule"), F.count_if("lead_fired_all").alias("all_rule"),
                 F.count_if(F.col("lead_fired_any") & ~F.col("lead_fired_all")).alias("disagree"),
                 rnd(F.avg("lead_fired_mean"), 9).alias("mean_fraction"))


@query("group_size_contamination", f"""WITH {R.ORDER_RUNS_SQL},
g AS (SELECT grp, count(*) AS size, count(*) FILTER (WHERE lead_fired) AS fired, bool_or(lead_fired) AS any_ FROM order_runs GROUP BY 1)
SELECT size, count(*) AS n_groups, CAST(sum(fired) AS BIGINT) AS runs_fired, CAST(sum(size) AS BIGINT) AS runs,
  round(sum(fired) / sum(size), 9) AS per_run_rate, round(avg(any_::INT), 9) AS any_rate FROM g GROUP BY 1""")
def group_size_contamination(spark, sf_dir):
    """How the any-rule inflates with group size while the per-run rate does not."""
    g = R.order_runs(spark, sf_dir).groupBy("grp").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("lead_fired").alias("fired"), F.bool_or("lead_fired").alias("any"))
    return g.groupBy("size").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("fired").alias("runs_fired"), F.sum("size").alias("runs"),
        rnd(F.sum("fired") / F.sum("size"), 9).alias("per_run_rate"), rnd(rate("any"), 9).alias("any_rate"))


@query("counts_by_cell", RUNS + f""", d AS ({R.detectors_long_sql("(SELECT * FROM runs WHERE scen = 'control')", 'c')})
SELECT c, detector, count(t) AS k, count(*) AS n, round({wilson_sql('count(t)', 'count(*)', -1)}, 9) AS lo95,
  round({wilson_sql('count(t)', 'count(*)', 1)}, 9) AS hi95, {wilson_sql('count(t)', 'count(*)', -1)} > 0.036 AS above_bar FROM d GROUP BY 1, 2""")
def counts_by_cell(spark, sf_dir):
    """False alarms and controls per coverage and detector with Wilson intervals."""
    d = R.detectors_long(user_runs(spark, sf_dir).where("scen = 'control'"), ["c"])
    g = d.groupBy("c", "detector").agg(F.count("t").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"lo95": rnd(wilson("k", "n", -1), 9), "hi95": rnd(wilson("k", "n", 1), 9),
                          "above_bar": wilson("k", "n", -1) > 0.036})


@query("missingness_accounting", RUNS + """
SELECT c, count(*) AS n_runs, count(*) FILTER (WHERE lead_max_score IS NULL) AS score_null, count(*) FILTER (WHERE t_lead IS NULL) AS lead_null,
  count(DISTINCT seed) AS n_seeds, round(stddev_samp(lead_max_score), 6) AS score_sd, round(min(lead_max_score), 6) AS score_min,
  round(max(lead_max_score), 6) AS score_max, median(lead_max_score) AS score_median,
  round(avg(CASE WHEN obs_events < 30 THEN 1.0::DOUBLE ELSE 0 END), 9) AS sparse_fraction FROM runs GROUP BY 1""")
def missingness_accounting(spark, sf_dir):
    """Undefined values and the stability of the score by coverage."""
    s = F.col("lead_max_score")
    return user_runs(spark, sf_dir).groupBy("c").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(s.isNull()).alias("score_null"),
        F.count_if(F.col("t_lead").isNull()).alias("lead_null"), F.count_distinct("seed").alias("n_seeds"),
        rnd(F.stddev_samp(s)).alias("score_sd"), rnd(F.min(s)).alias("score_min"), rnd(F.max(s)).alias("score_max"),
        F.median(s).alias("score_median"), rnd(rate(F.col("obs_events") < 30), 9).alias("sparse_fraction"))


# ------------------------------------------------------------------ two campaigns
KEYS = "c, arm, colour, sev, scen, rep"


@query("campaign_decomposition", BOTH + f""",
j AS (SELECT c, arm, colour, sev, o.seed <> n.seed AS mismatched, coalesce(o.t_lead, 360) AS lo, coalesce(n.t_lead, 360) AS ln,
        coalesce(o.t_lag, 360) AS go, coalesce(n.t_lag, 360) AS gn
      FROM old o JOIN runs n USING ({KEYS}) WHERE scen = 'degrade')
SELECT c, arm, colour, sev, count(*) AS n_shared, count(*) FILTER (WHERE mismatched) AS n_mismatched,
  round(avg(go - lo), 9) AS dt_old, round(avg(gn - ln), 9) AS dt_new, round(avg(gn - ln) - avg(go - lo), 9) AS dt_change,
  round(avg(gn - go), 9) AS by_comparator, round(avg(lo - ln), 9) AS by_threshold,
  abs(avg(gn - ln) - avg(go - lo) - avg(gn - go) - avg(lo - ln)) < 1e-9 AS identity_holds
FROM j GROUP BY 1, 2, 3, 4""")
def campaign_decomposition(spark, sf_dir):
    """Change of the mean lead between campaigns split into comparator and threshold effects, with its identity."""
    new, old = user_runs(spark, sf_dir), R.first_campaign(spark, sf_dir)
    pick = lambda df, p: df.where("scen = 'degrade'").select(
        *DESIGN, F.col("seed").alias(f"{p}seed"), F.coalesce("t_lead", "n_cycles").alias(f"{p}lead"),
        F.coalesce("t_lag", "n_cycles").alias(f"{p}lag"))
    j = pick(old, "o").join(pick(new, "n"), DESIGN)
    o, n = F.avg(F.col("olag") - F.col("olead")), F.avg(F.col("nlag") - F.col("nlead"))
    lag, lead = F.avg(F.col("nlag") - F.col("olag")), F.avg(F.col("olead") - F.col("nlead"))
    return j.groupBy("c", "arm", "colour", "sev").agg(
        F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("oseed") != F.col("nseed")).alias("n_mismatched"),
        rnd(o, 9).alias("dt_old"), rnd(n, 9).alias("dt_new"), rnd(n - o, 9).alias("dt_change"),
        rnd(lag, 9).alias("by_comparator"), rnd(lead, 9).alias("by_threshold"),
        (F.abs(n - o - lag - lead) < 1e-9).alias("identity_holds"))


@query("seed_noise_gauge", RUNS + """,
p AS (SELECT colour, avg(lead_fired::INT) FILTER (WHERE arm = 'mnar') AS mnar, avg(lead_fired::INT) FILTER (WHERE arm = 'mcar') AS mcar
      FROM runs WHERE c = 1.0 AND scen = 'control' GROUP BY 1)
SELECT colour, round(mnar, 9) AS mnar_fpr, round(mcar, 9) AS mcar_fpr, round(abs(mnar - mcar), 9) AS abs_difference,
  round(max(abs(mnar - mcar)) OVER (), 9) AS max_difference FROM p""")
def seed_noise_gauge(spark, sf_dir):
    """At full coverage the arms are the same configuration, so their difference is noise."""
    sel = user_runs(spark, sf_dir).where("c = 1.0 AND scen = 'control'")
    p = sel.groupBy("colour").pivot("arm", ["mnar", "mcar"]).agg(rate("lead_fired"))
    diff = F.abs(F.col("mnar") - F.col("mcar"))
    top = F.max(diff).over(W.partitionBy(F.lit(1)))  # three rows, one per colour
    return p.select("colour", rnd("mnar", 9).alias("mnar_fpr"), rnd("mcar", 9).alias("mcar_fpr"),
                    rnd(diff, 9).alias("abs_difference"), rnd(top, 9).alias("max_difference"))


@query("signed_and_absolute", RUNS + """
SELECT c, colour, count(dt_paired) AS n, round(avg(dt_paired), 9) AS mean_signed, round(avg(abs(dt_paired)), 9) AS mean_abs,
  round(avg(CASE WHEN dt_paired > 0 THEN 1.0::DOUBLE WHEN dt_paired IS NOT NULL THEN 0 END), 9) AS frac_positive
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2""")
def signed_and_absolute(spark, sf_dir):
    """Signed against absolute means and the share of runs pointing the other way."""
    x = F.col("dt_paired")
    return user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy("c", "colour").agg(
        F.count(x).alias("n"), rnd(F.avg(x), 9).alias("mean_signed"), rnd(F.avg(F.abs(x)), 9).alias("mean_abs"),
        rnd(rate(x > 0), 9).alias("frac_positive"))


@query("interaction_range", RUNS + f""",
p AS (SELECT c, rep, arm, avg(dt_censored) FILTER (WHERE colour = 'white') - avg(dt_censored) FILTER (WHERE colour = 'systematic') AS loss
      FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3),
s AS (SELECT c, avg(loss) AS m, stddev_samp(loss) AS sd, count(loss) AS n FROM p GROUP BY 1),
e AS (SELECT arg_min(m, c) AS lo, arg_max(m, c) AS hi, sqrt(arg_min(sd * sd / n, c) + arg_max(sd * sd / n, c)) AS se,
        arg_max(sd, c) AS sd_hi, arg_max(n, c) AS n_hi, arg_max(m, c) AS m_hi FROM s)
SELECT round(lo, 6) AS loss_low_c, round(hi, 6) AS loss_full_c, round(lo - hi, 6) AS interaction_range, round(se, 6) AS range_se,
  round({Z95 + Z80} * se, 6) AS mde, abs(lo - hi) < {Z95 + Z80} * se AS below_mde,
  CASE WHEN abs(m_hi) > 1e-12 THEN CAST(ceil(power({Z95 + Z80} * sd_hi / abs(m_hi), 2)) AS BIGINT) END AS n_needed
FROM e""")
def interaction_range(spark, sf_dir):
    """Change of a paired loss between lowest and full coverage with its minimum detectable effect."""
    value = lambda col: F.avg(F.when(F.col("colour") == col, F.col("dt_censored").cast("double")))
    p = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy(*GROUP).agg((value("white") - value("systematic")).alias("loss"))
    s = p.groupBy("c").agg(F.avg("loss").alias("m"), F.stddev_samp("loss").alias("sd"), F.count("loss").alias("n"))
    v = F.col("sd") * F.col("sd") / F.col("n")
    e = s.agg(F.min_by("m", "c").alias("lo"), F.max_by("m", "c").alias("hi"),
              F.sqrt(F.min_by(v, "c") + F.max_by(v, "c")).alias("se"), F.max_by("sd", "c").alias("sd_hi"))
    z = Z95 + Z80
    rng = F.col("lo") - F.col("hi")
    needed = F.ceil(F.pow(F.try_divide(z * F.col("sd_hi"), F.abs("hi")), 2))
    return e.select(rnd("lo").alias("loss_low_c"), rnd("hi").alias("loss_full_c"), rnd(rng).alias("interaction_range"),
                    rnd("se").alias("range_se"), rnd(z * F.col("se")).alias("mde"),
                    (F.abs(rng) < z * F.col("se")).alias("below_mde"),
                    F.when(F.abs("hi") > 1e-12, needed).alias("n_needed"))


@query("campaign_join_audit", BOTH + f"""
SELECT count(*) AS n_shared, count(*) FILTER (WHERE o.seed <> n.seed) AS seed_mismatches,
  count(*) FILTER (WHERE o.t_lead IS DISTINCT FROM n.t_lead) AS lead_changed FROM old o JOIN runs n USING ({KEYS})""")
def campaign_join_audit(spark, sf_dir):
    """Inner join of two campaigns on the full design key with a mismatch count."""
    o = R.first_campaign(spark, sf_dir).select(*DESIGN, F.col("seed").alias("os"), F.col("t_lead").alias("ot"))
    n = user_runs(spark, sf_dir).select(*DESIGN, "seed", "t_lead")
    return o.join(n, DESIGN).agg(
        F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("os") != F.col("seed")).alias("seed_mismatches"),
        F.count_if(~F.col("ot").eqNullSafe(F.col("t_lead"))).alias("lead_changed"))


@query("key_set_equality", BOTH + f"""
SELECT (SELECT count(*) FROM (SELECT {KEYS} FROM old WHERE lead_fired) a ANTI JOIN (SELECT {KEYS} FROM runs WHERE lead_fired) b USING ({KEYS})) AS only_old,
  (SELECT count(*) FROM (SELECT {KEYS} FROM runs WHERE lead_fired) a ANTI JOIN (SELECT {KEYS} FROM old WHERE lead_fired) b USING ({KEYS})) AS only_new,
  (SELECT count(*) FROM (SELECT {KEYS} FROM runs WHERE lead_fired) a SEMI JOIN (SELECT {KEYS} FROM old WHERE lead_fired) b USING ({KEYS})) AS shared""")
def key_set_equality(spark, sf_dir):
    """Fired keys of two campaigns compared both ways: one grouped pass instead of three joins."""
    o = R.first_campaign(spark, sf_dir).where("lead_fired").select(*DESIGN, F.lit(1).alias("o"), F.lit(0).alias("n"))
    n = user_runs(spark, sf_dir).where("lead_fired").select(*DESIGN, F.lit(0).alias("o"), F.lit(1).alias("n"))
    g = o.unionByName(n).groupBy(*DESIGN).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return g.agg(F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("only_old"),
                 F.count_if((F.col("o") == 0) & (F.col("n") == 1)).alias("only_new"),
                 F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("shared"))


@query("shared_identifiers", RUNS + """
SELECT count(*) AS shared FROM (SELECT DISTINCT rep FROM runs WHERE arm = 'mnar' AND lead_fired) a
SEMI JOIN (SELECT rep FROM runs WHERE arm = 'mcar' AND lead_fired) b USING (rep)""")
def shared_identifiers(spark, sf_dir):
    """Replicate identifiers two arms have in common."""
    fired = user_runs(spark, sf_dir).where("lead_fired")
    a = fired.where("arm = 'mnar'").select("rep").distinct()
    return a.join(fired.where("arm = 'mcar'").select("rep"), "rep", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query("set_operations", BOTH + """,
a AS (SELECT DISTINCT seed FROM runs WHERE lead_fired), b AS (SELECT DISTINCT seed FROM old WHERE lag_fired)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    """Union, intersection and difference of two key sets."""
    a = user_runs(spark, sf_dir).where("lead_fired").select("seed").distinct()
    b = R.first_campaign(spark, sf_dir).where("lag_fired").select("seed").distinct()
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.subtract(b)}
    out = None
    for name, df in ops.items():
        row = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("relative_swing", """
WITH w AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS a,
  avg(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1)
SELECT o_custkey, round(CASE WHEN abs(a) >= 1e-12 THEN (a - b) / a END, 9) AS swing FROM w""")
def relative_swing(spark, sf_dir):
    """Relative change between two window means per customer."""
    o = R.table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    w = o.groupBy("o_custkey").agg(F.avg(F.when(early, F.col("o_totalprice"))).alias("a"),
                                   F.avg(F.when(~early, F.col("o_totalprice"))).alias("b"))
    return w.select("o_custkey", rnd(C.relative_swing("a", "b"), 9).alias("swing"))


@query("ramp_cycle", RUNS + """
SELECT c, arm, CAST(round(50 + 310 * (0.48 - v) / (0.48 - 0.31)) AS INTEGER) AS cycle_at_level, round(v, 9) AS level,
  count(*) FILTER (WHERE t_lead < CAST(round(50 + 310 * (0.48 - v) / (0.48 - 0.31)) AS INTEGER)) AS fired_before
FROM (SELECT *, CAST(0.31 + 0.17 * c * 0.9 AS DOUBLE) AS v FROM runs) GROUP BY c, arm, v""")
def ramp_cycle(spark, sf_dir):
    """Cycle at which a linear driver passes a level, and alarms raised before it."""
    v = (F.lit(0.31) + F.lit(0.17) * F.col("c") * F.lit(0.9))
    at = C.ramp_cycle(F.col("v"), 50, 360, 0.48, 0.31)
    runs = user_runs(spark, sf_dir).withColumn("v", v).withColumn("cycle_at_level", at)
    return runs.groupBy("c", "arm", "v", "cycle_at_level").agg(
        F.count_if(F.col("t_lead") < F.col("cycle_at_level")).alias("fired_before")).select(
        "c", "arm", "cycle_at_level", rnd("v", 9).alias("level"), "fired_before")


@query("extreme_picks", RUNS + """,
g AS (SELECT c, arm, avg(dt_censored) AS m, avg(lead_fired::INT) AS r FROM runs WHERE scen = 'degrade' GROUP BY 1, 2)
SELECT arm, arg_max(c, m) AS c_at_max, arg_min(c, m) AS c_at_min, arg_min(c, abs(r - 0.5)) AS c_nearest_half, round(max(m), 9) AS max_mean
FROM g GROUP BY 1""")
def extreme_picks(spark, sf_dir):
    """Design level of the largest and smallest mean and of the rate nearest one half."""
    g = user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy("c", "arm").agg(
        F.avg("dt_censored").alias("m"), rate("lead_fired").alias("r"))
    return g.groupBy("arm").agg(F.max_by("c", "m").alias("c_at_max"), F.min_by("c", "m").alias("c_at_min"),
                                F.min_by("c", F.abs(F.col("r") - 0.5)).alias("c_nearest_half"), rnd(F.max("m"), 9).alias("max_mean"))
