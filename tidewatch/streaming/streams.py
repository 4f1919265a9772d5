"""Structured Streaming forms of the batch operators.

Every function maps a streaming DataFrame to a streaming DataFrame; :func:`run_available` drains the input that is there
into an append-only table, with its checkpoint, in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.alarms import LeadingRule
from tidewatch.session import shared_dir

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, sf_dir: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream of files. Watermarks need instants, so wall-clock times are read in the session's zone."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, then return the written table."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def cycle_means(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hourly mean and count per event type; an hour is published once, when the watermark has passed it."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type")
            .agg(F.avg("value").alias("y"), F.count("value").alias("n"))
            .select("event_type", F.col("window.start").alias("start"), "y", "n"))


def reporting_means(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pooled mean of the trailing ten hours, sliding by one."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "10 hours", "1 hour"), "event_type")
            .agg(F.avg("value").alias("y"), F.count("value").alias("n"))
            .select("event_type", F.col("window.end").alias("until"), "y", "n"))


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user: a session ends after ``gap`` without activity."""
    return (events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
            .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("until"), "n_events", "value"))


def open_close_pairs(opens: DataFrame, closes: DataFrame, within: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Every opening with the closings of the same user within the interval; both sides forget behind their watermark."""
    o = opens.withWatermark("ts", delay).select(F.col("user_id").alias("ou"), F.col("ts").alias("opened"), F.col("event_id").alias("open_id"))
    c = closes.withWatermark("ts", delay).select(F.col("user_id").alias("cu"), F.col("ts").alias("closed"), F.col("event_id").alias("close_id"), "value")
    on = (F.col("ou") == F.col("cu")) & (F.col("closed") >= F.col("opened")) & (F.col("closed") <= F.col("opened") + F.expr(f"INTERVAL {within}"))
    return o.join(c, on).select(F.col("ou").alias("user_id"), "open_id", "close_id", "opened", "closed", "value")


# ------------------------------------------------------------------ stateful alarm
STATE = ("last_cycle INT, tail ARRAY<DOUBLE>, n_var BIGINT, m_var DOUBLE, q_var DOUBLE, n_ac BIGINT, m_ac DOUBLE, q_ac DOUBLE, "
         "hits INT, alarm INT, waiting ARRAY<INT>, held ARRAY<DOUBLE>")
EMPTY = (-1, [], 0, 0.0, 0.0, 0, 0.0, 0.0, 0, -1, [], [])
ALARM = "key STRING, alarm_cycle INT, score DOUBLE"


def window_statistics(y: np.ndarray, need: int) -> tuple[float, float]:
    """Variance and lag-1 autocorrelation of one detrended window; NaN where undefined."""
    ok = ~np.isnan(y)
    if ok.sum() < need:
        return np.nan, np.nan
    t = np.arange(y.size, dtype=float)
    line = np.polynomial.polynomial.polyfit(t[ok] - t[ok].mean(), y[ok], 1)
    d = y - line[0] - line[1] * (t - t[ok].mean())
    a, b = d[:-1], d[1:]
    pair = ~np.isnan(a) & ~np.isnan(b)
    if pair.sum() < 4 or min(a[pair].std(), b[pair].std()) < 1e-12:
        return float(np.var(d[ok], ddof=1)), np.nan
    return float(np.var(d[ok], ddof=1)), float(np.corrcoef(a[pair], b[pair])[0, 1])


def sustained_alarms(cycles: DataFrame, key: str, rule: LeadingRule, delay: int = 0) -> DataFrame:
    """First sustained alarm per key from a stream of closed cycles ``(key, cycle, y)``, emitted once.

    The state of a key is the last ``window`` values, running reference moments until ``start`` and the count of
    consecutive hits, and the cycles of the last ``delay``: its size does not grow with the stream. A missing cycle is a gap
    in the numbers. A cycle is judged once one ``delay`` cycles later has been seen, so rows may come in any order within that
    span; one that comes later still is an error, not a gap. Only rules on one class without gap filling and with the
    mean of both legs can be kept in this state; others are refused.
    """
    if rule.max_gap or len(rule.classes) != 1 or rule.combine != "mean":
        raise ValueError("a streamed rule has one class, max_gap 0 and the mean of both legs")
    need = max(4, int(np.ceil(rule.min_frac * rule.window)))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tail, nv, mv, qv, na, ma, qa, hits, alarm, waiting, held = state.get if state.exists else EMPTY
        tail = list(tail)
        pending = {**dict(zip(waiting, held))}
        for b in batches:
            pending.update(zip(b["cycle"].astype(int), b["y"]))
        if pending and min(pending) <= last:
            raise ValueError(f"cycle {min(pending)} of {k[0]} came after cycle {last} had been judged: raise delay")
        ready = sorted(c for c in pending if c <= max(pending) - delay)
        found = None
        for cycle, y in [(c, pending.pop(c)) for c in ready]:
            for c in range(last + 1, int(cycle) + 1):
                tail = (tail + [float(y) if c == cycle and y is not None else float("nan")])[-rule.window:]
                var, ac = window_statistics(np.array(tail), need) if len(tail) == rule.window else (np.nan, np.nan)
                if rule.window - 1 <= c < rule.start:
                    if not np.isnan(var):
                        nv, d = nv + 1, var - mv
                        mv, qv = mv + d / nv, qv + d * (var - mv - d / nv)
                    if not np.isnan(ac):
                        na, d = na + 1, ac - ma
                        ma, qa = ma + d / na, qa + d * (ac - ma - d / na)
                score = np.nan
                if c >= rule.start and min(nv, na) >= 8:
                    zv = (var - mv) / max(np.sqrt(qv / (nv - 1)), 1e-9)
                    za = (ac - ma) / max(np.sqrt(qa / (na - 1)), 1e-9)
                    score = 0.5 * (zv + za)
                hits = hits + 1 if score >= rule.k else 0
                if hits >= rule.sustain and alarm < 0:
                    alarm = c
                    found = (k[0], c, float(score))
            last = int(cycle)
        state.update((last, tail, nv, mv, qv, na, ma, qa, hits, alarm, [int(c) for c in pending], [None if y is None else float(y) for y in pending.values()]))
        if found is not None:
            yield pd.DataFrame([found], columns=["key", "alarm_cycle", "score"])

    return cycles.groupBy(key).applyInPandasWithState(step, ALARM, STATE, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ retroactive revocation
def rederive_on_revocation(revocations: DataFrame, store: DataFrame, path: str, key: str, who: str, checkpoint: str) -> None:
    """Rewrite what was published for the keys a revocation touches, as a new version beside the old.

    Structured Streaming cannot take rows back, so each batch of revocations re-derives its affected keys from the
    event store and appends them under the next version; a reader takes the latest version of a key. Untouched keys
    are neither read again nor rewritten. The batch number is part of the version path, so a batch repeated after a
    failure overwrites itself. Withdrawals are kept beside the table: a later batch leaves out all that earlier ones
    withdrew. A cycle with nothing left keeps its published value.
    """
    withdrawn = f"{path.rstrip('/')}_withdrawn"

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.select(who).distinct().write.mode("overwrite").parquet(f"{withdrawn}/epoch={epoch}")
        revoked = spark.read.parquet(withdrawn).where(F.col("epoch") <= epoch).select(who).distinct().withColumn("_gone", F.lit(True))
        new = spark.read.parquet(f"{withdrawn}/epoch={epoch}").select(who)
        touched = store.join(new, who, "left_semi").select(key).distinct()
        marked = store.join(touched, key, "left_semi").join(revoked, who, "left")
        left = F.avg(F.when(F.col("_gone").isNull(), F.col("value")))
        rows = marked.groupBy(key, "cycle").agg(F.coalesce(left, F.avg("value")).alias("y"))
        rows.write.mode("overwrite").parquet(f"{path}/version={epoch + 1}")

    q = revocations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_version(spark: SparkSession, path: str, key: str) -> DataFrame:
    """For every key and cycle the value of the highest version."""
    t = spark.read.parquet(path)
    return t.groupBy(key, "cycle").agg(F.max_by("y", "version").alias("y"), F.max("version").alias("version"))
