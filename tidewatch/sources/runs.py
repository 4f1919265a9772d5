"""Per-run rows ("fact tables") derived from the event and order tables.

One user followed through one half of the month is a run: the first half is the control twin of the second. The
three colours are copies of the same run read at three thresholds, so they share their seed and are no independent
replicates. Everything comes from one grouped scan with map-side partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import finite, hour_cycle
from tidewatch.sources.tables import EVENT_ORIGIN, table

# Fixed values of the run table.
HALF_HOURS = 360
COVERAGES = (0.25, 0.5, 0.75, 1.0)
COLOURS = ("white", "red", "systematic")
LEAD_LEVELS = (150.0, 175.0, 200.0)
LAG_LEVEL = 150.0
FIRST_LEAD_LEVELS = (120.0, 140.0, 160.0)
FIRST_LAG_LEVEL = 180.0
DETECTORS = {"latency": "error", "giant": "click", "degree": "view", "suscept": "signup"}
LAG_TYPE = "purchase"
DESIGN = ["c", "arm", "colour", "sev", "scen", "rep"]
GROUP = ["c", "arm", "rep"]


def user_runs(spark: SparkSession, sf_dir: str, levels=LEAD_LEVELS, lag_level: float = LAG_LEVEL) -> DataFrame:
    """Rows ``(c, arm, colour, sev, scen, rep, seed, t_<detector>…, t_lead, t_lag, …)``."""
    ev = table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    h = hour_cycle("ts", EVENT_ORIGIN)
    t = F.pmod(h, F.lit(HALF_HOURS))
    kind, value = F.col("event_type"), finite("value")
    ev = ev.where((h >= 0) & (h < 2 * HALF_HOURS))  # the two halves; what lies outside is counted by axis_remainder
    first = {
        f"{d}_{colour}": F.min(F.when((kind == e) & (value >= level), F.col("t"))).alias(f"{d}_{colour}")
        for d, e in DETECTORS.items() for colour, level in zip(COLOURS, levels)
    }
    wide = (
        ev.withColumn("scen", F.when(h < HALF_HOURS, "control").otherwise("degrade")).withColumn("t", t)
        .groupBy("user_id", "scen").agg(
            *first.values(),
            F.min(F.when((kind == LAG_TYPE) & (value >= lag_level), F.col("t"))).alias("t_lag"),
            *[F.max(F.when(kind == e, value)).alias(f"max_{d}") for d, e in DETECTORS.items()],
            F.avg(F.when(value >= 25, 1.0).otherwise(0.0)).alias("achieved_edge_frac"),
            F.count(value).alias("obs_events"),
        )
    )
    copies = F.explode(F.array(*[
        F.struct(F.lit(colour).alias("colour"), *[F.col(f"{d}_{colour}").alias(f"t_{d}") for d in DETECTORS])
        for colour in COLOURS]))
    u = F.col("user_id")
    c = F.element_at(F.array(*[F.lit(x) for x in COVERAGES]), (u % 4 + 1).cast("int"))
    return (
        wide.withColumn("_copy", copies)
        .select(
            c.alias("c"), F.when(F.expr("user_id div 4") % 2 == 0, "mnar").otherwise("mcar").alias("arm"),
            F.col("_copy.colour").alias("colour"), F.lit("mid").alias("sev"), "scen",
            F.expr("user_id div 8").alias("rep"), u.alias("seed"),
            *[F.col(f"_copy.t_{d}").alias(f"t_{d}") for d in DETECTORS],
            F.col("_copy.t_latency").alias("t_lead"), "t_lag",
            F.col("max_latency").alias("lead_max_score"), *[f"max_{d}" for d in DETECTORS],
            "achieved_edge_frac", "obs_events", F.lit(HALF_HOURS).alias("n_cycles"),
        )
        .withColumns({
            "dt_censored": F.coalesce("t_lag", "n_cycles") - F.coalesce("t_lead", "n_cycles"),
            "dt_paired": F.col("t_lag") - F.col("t_lead"),
            "lead_fired": F.col("t_lead").isNotNull(), "lag_fired": F.col("t_lag").isNotNull(),
        })
    )


def user_runs_sql(name: str = "runs", levels=LEAD_LEVELS, lag_level: float = LAG_LEVEL) -> str:
    mins = ",\n    ".join(
        f"min(t) FILTER (WHERE event_type = '{e}' AND value >= {lv}) AS {d}_{col}"
        for d, e in DETECTORS.items() for col, lv in zip(COLOURS, levels))
    maxs = ", ".join(f"max(value) FILTER (WHERE event_type = '{e}') AS max_{d}" for d, e in DETECTORS.items())
    copies = " UNION ALL ".join(
        f"SELECT *, '{col}' AS colour, {', '.join(f'{d}_{col} AS t_{d}' for d in DETECTORS)} FROM {name}_wide"
        for col in COLOURS)
    return f"""
{name}_ev AS (
  SELECT user_id, event_type, value, CASE WHEN h < {HALF_HOURS} THEN 'control' ELSE 'degrade' END AS scen,
    CAST(h % {HALF_HOURS} AS INTEGER) AS t
  FROM (SELECT *, date_diff('day', DATE '{EVENT_ORIGIN}', CAST(ts AS DATE)) * 24 + hour(ts) AS h FROM events) WHERE h >= 0 AND h < {2 * HALF_HOURS}),
{name}_wide AS (
  SELECT user_id, scen,
    {mins},
    min(t) FILTER (WHERE event_type = '{LAG_TYPE}' AND value >= {lag_level}) AS t_lag,
    {maxs}, avg(CASE WHEN value >= 25 THEN 1.0::DOUBLE ELSE 0 END) AS achieved_edge_frac, count(value) AS obs_events
  FROM {name}_ev GROUP BY 1, 2),
{name}_copies AS ({copies}),
{name} AS (
  SELECT *, coalesce(t_lag, n_cycles) - coalesce(t_lead, n_cycles) AS dt_censored, t_lag - t_lead AS dt_paired,
    t_lead IS NOT NULL AS lead_fired, t_lag IS NOT NULL AS lag_fired
  FROM (SELECT (user_id % 4 + 1) * 0.25::DOUBLE AS c,
          CASE WHEN (user_id // 4) % 2 = 0 THEN 'mnar' ELSE 'mcar' END AS arm, colour, 'mid' AS sev, scen,
          user_id // 8 AS rep, user_id AS seed, t_latency, t_giant, t_degree, t_suscept, t_latency AS t_lead, t_lag,
          max_latency AS lead_max_score, max_latency, max_giant, max_degree, max_suscept, achieved_edge_frac,
          obs_events, {HALF_HOURS} AS n_cycles
        FROM {name}_copies))"""


def first_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs under the thresholds of an earlier campaign."""
    return user_runs(spark, sf_dir, FIRST_LEAD_LEVELS, FIRST_LAG_LEVEL)


def first_campaign_sql(name: str = "old") -> str:
    return user_runs_sql(name, FIRST_LEAD_LEVELS, FIRST_LAG_LEVEL)


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order, grouped by customer: groups of very different sizes."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return o.select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("run"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("level"),
        (F.col("o_totalprice") >= 400000).alias("lead_fired"), (F.col("o_orderstatus") == "F").alias("lag_fired"))


ORDER_RUNS_SQL = """
order_runs AS (
  SELECT o_custkey AS grp, o_orderkey AS run, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
         o_totalprice >= 400000 AS lead_fired, o_orderstatus = 'F' AS lag_fired FROM orders)"""


def detectors_long(runs: DataFrame, keep: list[str]) -> DataFrame:
    """Wide detector columns to rows ``(keep…, detector, t)``."""
    renamed = runs.select(*keep, *[F.col(f"t_{d}").alias(d) for d in DETECTORS])
    return renamed.unpivot(keep, list(DETECTORS), "detector", "t")


def detectors_long_sql(src: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{d}' AS detector, t_{d} AS t FROM {src}" for d in DETECTORS)
