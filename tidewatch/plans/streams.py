"""Streaming queries: the given events replayed through Structured Streaming until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.columns import rnd, unit_hash
from tidewatch.operators.alarms import LeadingRule
from tidewatch.plans import series as P
from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sources import tables as T
from tidewatch.sources.tables import unit_hash_sql
from tidewatch.streaming import expiry as X
from tidewatch.streaming import streams as L

MARK = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
HOUR = f"date_diff('day', DATE '{T.EVENT_ORIGIN}', CAST(ts AS DATE)) * 24 + hour(ts)"


def hour_index(c: str):
    """Whole hours from the origin to an instant; both sides are read in the session's zone."""
    return ((F.unix_timestamp(c) - F.unix_timestamp(F.lit(f"{T.EVENT_ORIGIN} 00:00:00"))) / 3600).cast("int")


@query("stream_cycle_means", f"""
SELECT event_type, CAST({HOUR} AS INTEGER) AS cycle, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2
HAVING TIMESTAMP '{T.EVENT_ORIGIN}' + (cycle + 1) * INTERVAL 1 HOUR <= {MARK}""")
def stream_cycle_means(spark, sf_dir):
    """Hourly means published as their hour closes."""
    t = L.run_available(L.cycle_means(L.event_stream(spark, sf_dir)), "cycle-means")
    return t.select("event_type", hour_index("start").alias("cycle"), rnd("y").alias("mean_value"), "n")


@query("stream_reporting_means", f"""
WITH e AS (SELECT event_type, value, {HOUR} AS h FROM events),
w AS (SELECT event_type, h + 1 + k.range AS until_cycle, value FROM e, range(10) k)
SELECT event_type, CAST(until_cycle AS INTEGER) AS until_cycle, round(avg(value), 7) AS mean_value, count(*) AS n FROM w
WHERE TIMESTAMP '{T.EVENT_ORIGIN}' + until_cycle * INTERVAL 1 HOUR <= {MARK} GROUP BY 1, 2""")
def stream_reporting_means(spark, sf_dir):
    """Sliding ten-hour pooled means as they close."""
    t = L.run_available(L.reporting_means(L.event_stream(spark, sf_dir)), "reporting-means")
    return t.select("event_type", hour_index("until").alias("until_cycle"), rnd("y", 7).alias("mean_value"), "n")


@query("stream_sessions", f"""
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o),
g AS (SELECT user_id, sid, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS n, sum(value) AS v FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS largest, round(sum(v), 4) AS value FROM g WHERE b <= {MARK} GROUP BY 1""")
def stream_sessions(spark, sf_dir):
    """Closed activity sessions per user."""
    t = L.run_available(L.sessions(L.event_stream(spark, sf_dir)), "sessions")
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("largest"),
                                    rnd(F.sum("value"), 4).alias("value"))


@query("stream_open_close", """
SELECT o.user_id, o.event_id AS open_id, c.event_id AS close_id, round(c.value, 6) AS value FROM events o JOIN events c
ON c.user_id = o.user_id AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 24 HOUR WHERE o.event_type = 'signup' AND c.event_type = 'purchase'""")
def stream_open_close(spark, sf_dir):
    """Openings paired with the closings that follow within a day: a stream-stream interval join."""
    ev = L.event_stream(spark, sf_dir)
    pairs = L.open_close_pairs(ev.where("event_type = 'signup'"), L.event_stream(spark, sf_dir).where("event_type = 'purchase'"))
    return L.run_available(pairs, "open-close").select("user_id", "open_id", "close_id", rnd("value").alias("value"))


TIE_DAYS, SILENT_DAYS = 5, 3


def islands_sql(keys: str, window: int) -> str:
    """CTEs ending in ``over(keys, first, last)``: lifetimes of closed days that had run out by the last watermark."""
    return f"""
day AS (SELECT DISTINCT {keys}, date_diff('day', DATE '{T.EVENT_ORIGIN}', CAST(ts AS DATE)) AS cycle FROM events),
mark AS (SELECT date_diff('day', DATE '{T.EVENT_ORIGIN}', CAST({MARK} AS DATE)) AS d),
fresh AS (SELECT *, CASE WHEN cycle - lag(cycle) OVER (PARTITION BY {keys} ORDER BY cycle) < {window} THEN 0 ELSE 1 END AS n FROM day, mark WHERE cycle < d),
run AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY cycle) AS r FROM fresh),
over AS (SELECT {keys}, CAST(min(cycle) AS INTEGER) AS first, CAST(max(cycle) AS INTEGER) AS last FROM run GROUP BY {keys}, r HAVING max(cycle) + {window} <= max(d))"""


def expired(spark, sf_dir, keys, window, name):
    with X.timed_state(spark):
        return L.run_available(X.lifetimes(L.event_stream(spark, sf_dir), keys, window, T.EVENT_ORIGIN), name)


@query("stream_live_ties", f"WITH {islands_sql('user_id, event_type', TIE_DAYS)}" + f"""
SELECT CAST(c.range AS INTEGER) AS cycle, event_type, count(*) AS n_ties, CAST(sum(user_id) AS BIGINT) AS id_sum FROM over, range(0, 2000) c
WHERE c.range BETWEEN first + 1 AND last + {TIE_DAYS - 1} GROUP BY 1, 2""")
def stream_live_ties(spark, sf_dir):
    """Ties between users and kinds of event under a sliding window with refresh: made, refreshed and expired in the stream."""
    over = expired(spark, sf_dir, ["user_id", "event_type"], TIE_DAYS, "ties")
    live = over.select("user_id", "event_type", F.explode(F.sequence(F.col("first") + 1, F.col("last") + TIE_DAYS - 1)).alias("cycle"))
    return live.groupBy("cycle", "event_type").agg(F.count(F.lit(1)).alias("n_ties"), F.sum("user_id").alias("id_sum"))


@query("stream_silences", f"WITH {islands_sql('user_id', SILENT_DAYS)} SELECT user_id, first, last FROM over")
def stream_silences(spark, sf_dir):
    """Every time a user falls silent, reported by a timer: when the activity began and its last day."""
    return expired(spark, sf_dir, ["user_id"], SILENT_DAYS, "silences")


@query("stream_longest_inactive", f"""WITH {islands_sql('user_id', SILENT_DAYS)}, back AS (SELECT user_id, max(cycle) AS seen FROM day, mark WHERE cycle < d GROUP BY 1)
SELECT user_id, max(last) AS last_active, CAST((SELECT d FROM mark) - max(last) AS INTEGER) AS idle FROM over JOIN back USING (user_id) WHERE last = seen
GROUP BY 1 ORDER BY last_active, user_id LIMIT 5""")
def stream_longest_inactive(spark, sf_dir):
    """The five users silent for longest when the stream ends, from the silences it reported."""
    from tidewatch.session import cut_lineage
    over = cut_lineage(expired(spark, sf_dir, ["user_id"], SILENT_DAYS, "inactive"))
    events = T.table(spark, sf_dir, "events", "user_id", "ts")
    day = F.datediff(F.col("ts").cast("date"), F.lit(T.EVENT_ORIGIN))
    mark = events.agg(F.datediff((F.max("ts") - F.expr("INTERVAL 1 HOUR")).cast("date"), F.lit(T.EVENT_ORIGIN)).alias("d")).first()["d"]
    seen = events.where("user_id IS NOT NULL").select("user_id", day.alias("day")).where(F.col("day") < mark).groupBy("user_id").agg(F.max("day").alias("seen"))
    last = over.groupBy("user_id").agg(F.max("last").alias("last_active")).join(seen, "user_id").where("last_active = seen")
    return last.orderBy("last_active", "user_id").limit(5).select("user_id", "last_active", (F.lit(mark) - F.col("last_active")).alias("idle"))


RULE = LeadingRule(window=24, classes=("y",), k=1.5, sustain=3, start=120, max_gap=0)
KEY = ["event_type"]
STREAM_SCORE = f"""WITH ev AS (SELECT * FROM events), {T.EVENT_HOURS_SQL},
closed AS (SELECT event_type, CAST(cycle AS INTEGER) AS cycle, y FROM event_hours WHERE TIMESTAMP '{T.EVENT_ORIGIN}' + (cycle + 1) * INTERVAL 1 HOUR <= {MARK}),
{P.score_sql('closed', KEY, RULE)},{P.lead_sql(KEY, RULE)}"""


@query("stream_alarms", STREAM_SCORE + """
SELECT l.event_type, l.t_lead AS alarm_cycle, round(s.score, 6) AS score FROM lead l JOIN scored s ON s.event_type = l.event_type AND s.cycle = l.t_lead""")
def stream_alarms(spark, sf_dir):
    """Live alarms: closed hours stream into a keyed state that raises each key's first sustained alarm."""
    closed = L.run_available(L.cycle_means(L.event_stream(spark, sf_dir)), "closed-hours")
    path = f"{shared_dir(spark)}/hours-{uuid.uuid4().hex}"
    closed.select("event_type", hour_index("start").alias("cycle"), "y").write.mode("errorifexists").parquet(path)
    hours = spark.readStream.schema("event_type STRING, cycle INT, y DOUBLE").parquet(path)
    alarms = L.run_available(L.sustained_alarms(hours, "event_type", RULE), "alarms")
    return alarms.select(F.col("key").alias("event_type"), "alarm_cycle", rnd("score").alias("score"))


SHARDS = 40
REVOKED = unit_hash_sql("revoke", "user_id")


@query("stream_revocation", f"""
WITH s AS (SELECT user_id % {SHARDS} AS shard, CAST({HOUR} AS INTEGER) // 24 AS cycle, value, {REVOKED} < 0.1 AS gone FROM events),
t AS (SELECT shard, bool_or(gone) AS touched FROM s GROUP BY 1)
SELECT shard, cycle, round(coalesce(avg(value) FILTER (WHERE NOT gone), avg(value)), 6) AS y, any_value(touched) AS revised FROM s JOIN t USING (shard) GROUP BY 1, 2""")
def stream_revocation(spark, sf_dir):
    """Published daily means, then a stream of revocations that rewrites the affected shards as a new version."""
    ev = T.table(spark, sf_dir, "events", "user_id", "ts", "value")
    store = ev.select("user_id", F.pmod("user_id", F.lit(SHARDS)).alias("shard"), "value",
                      F.datediff("ts", F.lit(T.EVENT_ORIGIN).cast("date")).alias("cycle"))
    base = f"{shared_dir(spark)}/revocation-{uuid.uuid4().hex}"
    store.groupBy("shard", "cycle").agg(F.avg("value").alias("y")).write.mode("errorifexists").parquet(f"{base}/table/version=0")
    store.select("user_id").distinct().where(unit_hash("revoke", "user_id") < 0.1).write.mode("errorifexists").parquet(f"{base}/revocations")
    stream = spark.readStream.schema("user_id BIGINT").parquet(f"{base}/revocations")
    L.rederive_on_revocation(stream, store, f"{base}/table", "shard", "user_id", f"{base}/checkpoint")
    return L.latest_version(spark, f"{base}/table", "shard").select("shard", "cycle", rnd("y").alias("y"), (F.col("version") > 0).alias("revised"))


@query("stream_revocation_batches", f"""
WITH s AS (SELECT user_id % {SHARDS} AS shard, CAST({HOUR} AS INTEGER) // 24 AS cycle, value, {REVOKED} < 0.3 AS gone FROM events)
SELECT shard, cycle, round(coalesce(avg(value) FILTER (WHERE NOT gone), avg(value)), 6) AS y FROM s GROUP BY 1, 2""")
def stream_revocation_batches(spark, sf_dir):
    """Withdrawals that arrive in three batches with shards in common: what an earlier one took out stays out."""
    ev = T.table(spark, sf_dir, "events", "user_id", "ts", "value")
    store = ev.select("user_id", F.pmod("user_id", F.lit(SHARDS)).alias("shard"), "value",
                      F.datediff("ts", F.lit(T.EVENT_ORIGIN).cast("date")).alias("cycle"))
    base = f"{shared_dir(spark)}/revocation-{uuid.uuid4().hex}"
    store.groupBy("shard", "cycle").agg(F.avg("value").alias("y")).write.mode("errorifexists").parquet(f"{base}/table/version=0")
    users = store.select("user_id").distinct().withColumn("u", unit_hash("revoke", "user_id"))
    for k in range(3):
        part = users.where((F.col("u") >= 0.1 * k) & (F.col("u") < (0.1 * k + 0.1 if k < 2 else 0.3))).select("user_id")
        part.coalesce(1).write.mode("append").parquet(f"{base}/revocations")
    stream = spark.readStream.schema("user_id BIGINT").option("maxFilesPerTrigger", 1).parquet(f"{base}/revocations")
    L.rederive_on_revocation(stream, store, f"{base}/table", "shard", "user_id", f"{base}/checkpoint")
    return L.latest_version(spark, f"{base}/table", "shard").select("shard", "cycle", rnd("y").alias("y"))
