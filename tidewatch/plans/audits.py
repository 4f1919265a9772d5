"""Checks held against tables with planted faults or numbers from outside, and what the declared axes leave out."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from tidewatch.functions.columns import day_cycle, hour_cycle, rnd
from tidewatch.functions.intervals import Z95, rate, wilson, wilson_sql
from tidewatch.operators import calibrate
from tidewatch.operators import checks as K
from tidewatch.operators import survival as S
from tidewatch.plans.calibration import CURVE, TARGET, null_curve
from tidewatch.plans.checks import RUNS, cells
from tidewatch.plans.registry import query
from tidewatch.plans.series import RULE
from tidewatch.session import cut_lineage, shared_dir
from tidewatch.sources import store
from tidewatch.sources import tables as T
from tidewatch.sources.runs import user_runs

AXES_SQL = f"""
WITH a AS (
  SELECT 'events' AS source, date_diff('day', DATE '{T.EVENT_ORIGIN}', CAST(ts AS DATE)) * 24 + hour(ts) AS cycle, {T.EVENT_HOURS} AS n FROM events
  UNION ALL SELECT 'lineitem', CAST(floor(date_diff('day', DATE '{T.SHIP_ORIGIN}', CAST(l_shipdate AS DATE)) / {T.SHIP_CYCLE_DAYS}) AS BIGINT), {T.SHIP_CYCLES} FROM lineitem
  UNION ALL SELECT 'orders', date_diff('day', DATE '{T.ORDER_ORIGIN}', CAST(o_orderdate AS DATE)), {T.ORDER_DAYS} FROM orders)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE cycle < 0 OR cycle >= n) AS n_outside, CAST(min(cycle) AS INTEGER) AS first_cycle,
  CAST(max(cycle) AS INTEGER) AS last_cycle FROM a GROUP BY 1"""


@query("axis_remainder", AXES_SQL)
def axis_remainder(spark, sf_dir):
    """Rows of each source that its declared cycle axis leaves out, and the range they span."""
    axes = [("events", hour_cycle("ts", T.EVENT_ORIGIN), "ts", T.EVENT_HOURS),
            ("lineitem", day_cycle("l_shipdate", T.SHIP_ORIGIN, T.SHIP_CYCLE_DAYS), "l_shipdate", T.SHIP_CYCLES),
            ("orders", day_cycle("o_orderdate", T.ORDER_ORIGIN), "o_orderdate", T.ORDER_DAYS)]
    out = None
    for name, cycle, col, n in axes:
        one = T.table(spark, sf_dir, name, col).select(cycle.alias("cycle")).agg(
            F.count(F.lit(1)).alias("n_rows"), T.outside_axis(F.col("cycle"), n).alias("n_outside"),
            F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle")).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("stored_cells_with_faults", RUNS + """, cell AS (SELECT DISTINCT c, arm, colour, scen FROM runs),
found AS (SELECT 'only fresh' AS problem, 3 * count(*) AS n_fields FROM cell WHERE colour = 'red' AND scen = 'control'
  UNION ALL SELECT 'differs', count(*) FROM cell WHERE c = 0.25 AND arm = 'mnar' AND NOT (colour = 'red' AND scen = 'control')
  UNION ALL SELECT 'only stored', 3 * count(*) FROM (SELECT 1 FROM cell WHERE c = 1.0 AND scen = 'degrade'))
SELECT problem, n_fields FROM found WHERE n_fields > 0""")
def stored_cells_with_faults(spark, sf_dir):
    """A cell table is written once with cells left out, changed and made up; recomputing the cells has to find just those."""
    fresh = cells(spark, sf_dir)
    changed = fresh.where("NOT (colour = 'red' AND scen = 'control')").withColumn(
        "dt", F.col("dt") + F.when((F.col("c") == 0.25) & (F.col("arm") == "mnar"), 0.5).otherwise(0.0))
    made_up = fresh.where("c = 1.0 AND scen = 'degrade'").withColumn("c", F.lit(2.0))
    path = f"{shared_dir(spark)}/faulty-cells-{uuid.uuid4().hex}"
    store.write_once(changed.unionByName(made_up), path)
    found = K.recompute_differences(spark.read.parquet(path), fresh, ["c", "arm", "colour", "scen"], ["n", "dt", "lead_rate"])
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n_fields"))


@query("sums_with_faults", RUNS + """
SELECT arm, count(*) AS n_violations FROM (SELECT DISTINCT c, arm, colour FROM runs WHERE scen = 'degrade') WHERE arm = 'mcar' GROUP BY 1""")
def sums_with_faults(spark, sf_dir):
    """Contributions that do not add up, after the means of one arm have been moved."""
    s = S.censoring_shares(user_runs(spark, sf_dir).where("scen = 'degrade'"), ["c", "arm", "colour"])
    moved = s.withColumn("mean", F.col("mean") + F.when(F.col("arm") == "mcar", 1.0).otherwise(0.0))
    return K.sum_to_whole(moved, [f"contribution_{p}" for p in S.PATTERNS], "mean").groupBy("arm").agg(F.count(F.lit(1)).alias("n_violations"))


#: Horizons as declared by colour; the last does not agree with the rows.
DECLARED = {"white": 360, "red": 360, "systematic": 300}


@query("undeclared_horizons", RUNS + f""", d AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in DECLARED.items())}) t(colour, declared))
SELECT colour, min(n_cycles) AS lo, max(n_cycles) AS hi, max(declared) AS declared FROM runs JOIN d USING (colour) GROUP BY 1
HAVING min(n_cycles) <> max(n_cycles) OR min(n_cycles) <> max(declared)""")
def undeclared_horizons(spark, sf_dir):
    """Variants whose rows do not carry the horizon declared for them."""
    declared = F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv])[F.col("colour")]
    return K.declared_values(user_runs(spark, sf_dir), ["colour"], "n_cycles", declared)


#: Quoted false-alarm rates with their cells and tolerances; the last quotes a cell that does not exist.
CLAIMS = [("quarter seen, masked by degree", 0.25, "mnar", 0.9, 0.05), ("half seen, masked by degree", 0.5, "mnar", 0.4, 0.05),
          ("all seen, masked at random", 1.0, "mcar", 0.95, 0.1), ("a third seen", 0.33, "mcar", 0.5, 0.5)]


@query("outside_claims", RUNS + f""", cl AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {c}::DOUBLE, '{m}', {q}::DOUBLE, {t}::DOUBLE)" for a, c, m, q, t in CLAIMS)}) t(claim, c, arm, quoted, tolerance)),
t AS (SELECT c, arm, avg(lead_fired::INT) AS v FROM runs WHERE scen = 'control' AND colour = 'white' GROUP BY 1, 2)
SELECT claim, quoted, count(v) AS matches, round(max(v), 9) AS actual, count(v) = 1 AND abs(max(v) - quoted) <= tolerance AS holds
FROM cl LEFT JOIN t USING (c, arm) GROUP BY claim, quoted, tolerance""")
def outside_claims(spark, sf_dir):
    """Numbers quoted elsewhere, bound to the cells they quote."""
    t = user_runs(spark, sf_dir).where("scen = 'control' AND colour = 'white'").groupBy("c", "arm").agg(rate("lead_fired").alias("v"))
    quoted = spark.createDataFrame(CLAIMS, "claim string, c double, arm string, quoted double, tolerance double")
    found = K.bind_claims(quoted, t, ["c", "arm"], "v")
    return found.select("claim", "quoted", "matches", rnd("actual", 9).alias("actual"), F.coalesce("holds", F.lit(False)).alias("holds"))


@query("rule_reselection", CURVE + f""",
pick AS (SELECT k FROM curve WHERE 1.0 * n_false / n <= {TARGET} ORDER BY k LIMIT 1)
SELECT {RULE.leading.k}::DOUBLE AS stored_k, pick.k AS selected_k, pick.k = {RULE.leading.k} AS agrees, round(1.0 * n_false / n, 9) AS stored_fpr,
  1.0 * n_false / n <= {TARGET} AS stored_admissible FROM curve, pick WHERE curve.k = {RULE.leading.k}""")
def rule_reselection(spark, sf_dir):
    """A stored rule against the one that its calibration data select now: same threshold, and is the stored one admissible?"""
    path = f"{shared_dir(spark)}/rule-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(asdict(RULE)),)], "value string").coalesce(1).write.text(path)
    stored = store.load_rule(spark, path).leading
    curve = cut_lineage(null_curve(spark, sf_dir))
    pick = calibrate.smallest_admissible(curve, [], TARGET).select(F.col("k").alias("selected_k"))
    own = curve.where(F.col("k") == stored.k).select(F.col("k").alias("stored_k"), "fpr")
    return own.join(pick, F.lit(True)).select("stored_k", "selected_k", (F.col("selected_k") == F.col("stored_k")).alias("agrees"),
                                              rnd("fpr", 9).alias("stored_fpr"), (F.col("fpr") <= TARGET).alias("stored_admissible"))


@query("cell_intervals", RUNS + f"""
SELECT c, arm, colour, count(*) AS n, round(avg(dt_censored), 9) AS dt_mean, round(stddev_samp(dt_censored) / sqrt(count(*)), 9) AS dt_se,
  round(avg(dt_censored) - {Z95} * stddev_samp(dt_censored) / sqrt(count(*)), 7) AS dt_lo,
  round(avg(dt_censored) + {Z95} * stddev_samp(dt_censored) / sqrt(count(*)), 7) AS dt_hi
FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3""")
def cell_intervals(spark, sf_dir):
    """Standard error and normal 95 % interval of the mean lead of every cell; NULL for a single run."""
    mean, se = F.avg("dt_censored"), F.stddev_samp("dt_censored") / F.sqrt(F.count("dt_censored"))
    return user_runs(spark, sf_dir).where("scen = 'degrade'").groupBy("c", "arm", "colour").agg(
        F.count(F.lit(1)).alias("n"), rnd(mean, 9).alias("dt_mean"), rnd(se, 9).alias("dt_se"),
        rnd(mean - Z95 * se, 7).alias("dt_lo"), rnd(mean + Z95 * se, 7).alias("dt_hi"))


WON, DECIDED = "count(*) FILTER (WHERE lead_fired AND (NOT lag_fired OR t_lead < t_lag))", "count(*) FILTER (WHERE lead_fired OR lag_fired)"


@query("win_probability_interval", RUNS + f""", w AS (SELECT c, arm, colour, {WON} AS k, {DECIDED} AS n FROM runs WHERE scen = 'degrade' GROUP BY 1, 2, 3)
SELECT c, arm, colour, k AS n_lead_first, n AS n_decided, round({wilson_sql('k', 'n', -1)}, 9) AS lo, round({wilson_sql('k', 'n', 1)}, 9) AS hi FROM w""")
def win_probability_interval(spark, sf_dir):
    """Wilson interval of the probability that the leading detector comes first."""
    w = S.win_probability(user_runs(spark, sf_dir).where("scen = 'degrade'"), ["c", "arm", "colour"])
    return w.select("c", "arm", "colour", "n_lead_first", "n_decided", rnd(wilson("n_lead_first", "n_decided", -1), 9).alias("lo"),
                    rnd(wilson("n_lead_first", "n_decided", 1), 9).alias("hi"))


@query("kept_series", """
WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT step, built, n_rows, n_lines FROM (SELECT 'first' AS step, TRUE AS built, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_lines FROM a
  UNION ALL SELECT 'again', FALSE, count(*), CAST(sum(n) AS BIGINT) FROM a UNION ALL SELECT 'other query', TRUE, count(*), CAST(sum(n) AS BIGINT) FROM a WHERE n > 5
  UNION ALL SELECT 'input grown', TRUE, count(*), CAST(sum(n) AS BIGINT) FROM b)""")
def kept_series(spark, sf_dir):
    """A kept table is read again while query and input are the same, and built anew when either changes."""
    base = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    lines = T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    lines.where("l_orderkey % 2 = 0").write.parquet(f"{base}/input")
    steps, seen = [], set()

    def look(step, least=0):
        per = spark.read.schema(lines.schema).parquet(f"{base}/input").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        kept = store.materialised(per.where(F.col("n") > least) if least else per, f"{base}/kept")
        folders = {path.rsplit("/", 2)[-2] for path in kept.inputFiles()}
        built = not folders <= seen
        seen.update(folders)
        steps.append(kept.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_lines")).select(
            F.lit(step).alias("step"), F.lit(built).alias("built"), "n_rows", "n_lines"))

    look("first")
    look("again")
    look("other query", 5)
    lines.where("l_orderkey % 2 <> 0").write.mode("append").parquet(f"{base}/input")
    look("input grown")
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out
