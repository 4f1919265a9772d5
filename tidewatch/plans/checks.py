"""Reproducibility checks over the result tables of other queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.columns import rnd
from tidewatch.functions.intervals import rate
from tidewatch.operators import checks as K
from tidewatch.operators import survival as S
from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sources import runs as R
from tidewatch.sources import store
from tidewatch.sources.runs import DETECTORS, first_campaign_sql, user_runs, user_runs_sql

RUNS = f"WITH {user_runs_sql()}"


def cells(spark, sf_dir):
    return user_runs(spark, sf_dir).groupBy("c", "arm", "colour", "scen").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dt_censored").alias("dt"), rate("lead_fired").alias("lead_rate"))


@query("recompute_cells", RUNS + """
SELECT count(*) AS n_cells, 0::BIGINT AS n_differences FROM (SELECT DISTINCT c, arm, colour, scen FROM runs)""")
def recompute_cells(spark, sf_dir):
    """Every cell recomputed by another route, detector rows first, and compared within tolerance."""
    stored = cells(spark, sf_dir)
    long = R.detectors_long(user_runs(spark, sf_dir), ["c", "arm", "colour", "scen", "t_lag", "n_cycles"]).where("detector = 'latency'")
    fresh = long.groupBy("c", "arm", "colour", "scen").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.coalesce("t_lag", "n_cycles")) - F.sum(F.coalesce("t", "n_cycles"))).alias("d"),
        (F.count("t") / F.count(F.lit(1))).alias("lead_rate")).withColumn("dt", F.col("d") / F.col("n"))
    bad = K.recompute_differences(stored, fresh, ["c", "arm", "colour", "scen"], ["n", "dt", "lead_rate"])
    return stored.agg(F.count(F.lit(1)).alias("n_cells"), F.max(bad.agg(F.count(F.lit(1))).scalar()).alias("n_differences"))


@query("table_difference", f"WITH {user_runs_sql()},{first_campaign_sql()}," + """
u AS (SELECT c, arm, colour, scen, rep, t_lead, 1 AS n FROM runs UNION ALL SELECT c, arm, colour, scen, rep, t_lead, -1 FROM old)
SELECT c, arm, colour, scen, rep, t_lead, CAST(sum(n) AS BIGINT) AS surplus FROM u GROUP BY 1, 2, 3, 4, 5, 6 HAVING sum(n) <> 0""")
def table_difference(spark, sf_dir):
    """Deep difference of two campaigns' row tables."""
    cols = ["c", "arm", "colour", "scen", "rep", "t_lead"]
    return K.table_difference(user_runs(spark, sf_dir).select(*cols), R.first_campaign(spark, sf_dir).select(*cols))


@query("seed_hygiene", """
SELECT event_type, count(user_id) AS n, count(DISTINCT user_id) AS n_distinct, min(user_id) AS lo, max(user_id) AS hi, count(user_id) = count(DISTINCT user_id) AS "unique",
  max(user_id) - min(user_id) + 1 = count(DISTINCT user_id) AS contiguous FROM events GROUP BY 1""")
def seed_hygiene(spark, sf_dir):
    """Range, uniqueness and contiguity of identifiers per block."""
    return K.seed_hygiene(R.table(spark, sf_dir, "events", "event_type", "user_id"), ["event_type"], "user_id")


@query("shared_seeds", """
SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_blocks FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def shared_seeds(spark, sf_dir):
    """Identifiers that blocks meant to be disjoint have in common."""
    return K.shared_seeds(R.table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag"), "l_returnflag", "l_suppkey")


@query("reproduction_check", f"WITH {user_runs_sql()},{first_campaign_sql()}," + f"""
a AS (SELECT c, detector, count(t) AS k, count(*) AS n FROM ({R.detectors_long_sql("(SELECT * FROM runs WHERE scen = 'control')", 'c')}) GROUP BY 1, 2),
b AS (SELECT c, detector, count(t) AS k, count(*) AS n FROM ({R.detectors_long_sql("(SELECT * FROM old WHERE scen = 'control')", 'c')}) GROUP BY 1, 2)
SELECT c, detector, a.k AS k_now, a.n AS n_now, b.k AS k_then, b.n AS n_then, a.k = b.k AND a.n = b.n AS match FROM a JOIN b USING (c, detector) WHERE c IN (0.25, 0.5)""")
def reproduction_check(spark, sf_dir):
    """Counts of the cells two grids share."""
    def counts(runs, s):
        d = R.detectors_long(runs.where("scen = 'control' AND c IN (0.25, 0.5)"), ["c"])
        return d.groupBy("c", "detector").agg(F.count("t").alias(f"k_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    j = counts(user_runs(spark, sf_dir), "now").join(counts(R.first_campaign(spark, sf_dir), "then"), ["c", "detector"])
    return j.withColumn("match", (F.col("k_now") == F.col("k_then")) & (F.col("n_now") == F.col("n_then")))


@query("sum_to_whole", RUNS + """
SELECT count(*) AS n_cells, 0::BIGINT AS n_violations FROM (SELECT DISTINCT c, arm, colour FROM runs WHERE scen = 'degrade')""")
def sum_to_whole(spark, sf_dir):
    """Contributions must add to the mean and fractions to one in every cell."""
    s = S.censoring_shares(user_runs(spark, sf_dir).where("scen = 'degrade'"), ["c", "arm", "colour"]).withColumn("one", F.lit(1.0))
    bad = K.sum_to_whole(s, [f"contribution_{p}" for p in S.PATTERNS], "mean").select("c").unionByName(
        K.sum_to_whole(s, [f"frac_{p}" for p in S.PATTERNS], "one").select("c"))
    return s.agg(F.count(F.lit(1)).alias("n_cells"), F.max(bad.agg(F.count(F.lit(1))).scalar()).alias("n_violations"))


@query("declared_overrides", RUNS + """
SELECT colour, count(*) AS n, min(n_cycles) AS lo, max(n_cycles) AS hi, min(n_cycles) = max(n_cycles) AND min(n_cycles) = 360 AS as_declared FROM runs GROUP BY 1""")
def declared_overrides(spark, sf_dir):
    """Each variant's rows carry the declared horizon."""
    runs = user_runs(spark, sf_dir)
    return runs.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("n_cycles").alias("lo"), F.max("n_cycles").alias("hi"),
                                      ((F.min("n_cycles") == F.max("n_cycles")) & (F.min("n_cycles") == R.HALF_HOURS)).alias("as_declared"))


@query("claim_binding", RUNS + """,
t AS (SELECT c, arm, avg(lead_fired::INT) AS v FROM runs WHERE scen = 'control' AND colour = 'white' GROUP BY 1, 2), cl AS (SELECT c, arm, round(v, 3) AS quoted FROM t)
SELECT 'rate at ' || c || ' ' || arm AS claim, quoted, 1::BIGINT AS matches, round(v, 9) AS actual, abs(v - quoted) <= 0.0006 AS holds FROM t JOIN cl USING (c, arm)""")
def claim_binding(spark, sf_dir):
    """Numbers as quoted to three decimals, bound to the cells they quote."""
    t = user_runs(spark, sf_dir).where("scen = 'control' AND colour = 'white'").groupBy("c", "arm").agg(rate("lead_fired").alias("v"))
    quoted = t.select("c", "arm", F.concat(F.lit("rate at "), F.col("c").cast("string"), F.lit(" "), "arm").alias("claim"),
                      F.round("v", 3).alias("quoted"), F.lit(0.0006).alias("tolerance"))
    return K.bind_claims(quoted, t, ["c", "arm"], "v").select("claim", "quoted", "matches", rnd("actual", 9).alias("actual"), "holds")


@query("stored_result_check", RUNS + """
SELECT count(*) AS n_stored, 0::BIGINT AS n_differences FROM (SELECT DISTINCT c, arm, colour, scen FROM runs)""")
def stored_result_check(spark, sf_dir):
    """Check mode: write a result once, recompute it and compare the two tables."""
    path = f"{shared_dir(spark)}/stored-cells-{uuid.uuid4().hex}"
    fresh = cells(spark, sf_dir)
    store.write_once(fresh, path)
    stored = spark.read.parquet(path)
    bad = K.recompute_differences(stored, fresh, ["c", "arm", "colour", "scen"], ["n", "dt", "lead_rate"])
    return stored.agg(F.count(F.lit(1)).alias("n_stored"), F.max(bad.agg(F.count(F.lit(1))).scalar()).alias("n_differences"))


@query("stored_rows", RUNS + """
SELECT scen, count(*) AS n_rows, count(t_lead) AS n_fired, CAST(sum(seed) AS BIGINT) AS seed_sum FROM runs GROUP BY 1""")
def stored_rows(spark, sf_dir):
    """Run rows written as JSON, a folder per scenario, and read back with a declared schema."""
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows = user_runs(spark, sf_dir).select("scen", "c", "arm", "colour", "rep", "seed", "t_lead", "t_lag")
    rows.write.mode("errorifexists").partitionBy("scen").json(path)
    back = spark.read.schema("scen STRING, seed BIGINT, t_lead INT").json(path)
    return back.groupBy("scen").agg(F.count(F.lit(1)).alias("n_rows"), F.count("t_lead").alias("n_fired"), F.sum("seed").alias("seed_sum"))


@query("content_digest", """
WITH h AS (SELECT event_type, CAST('0x' || substr(md5(event_id || '|' || user_id || '|' || event_type || '|' || props), 1, 10) AS BIGINT) AS d FROM events)
SELECT event_type, count(*) AS n, CAST(sum(d) AS BIGINT) AS digest FROM h GROUP BY 1""")
def content_digest(spark, sf_dir):
    """Digest of a table's content that depends neither on row order nor on files."""
    ev = R.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), store.row_digest("event_id", "user_id", "event_type", "props").alias("digest"))
