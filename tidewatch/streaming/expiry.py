"""Ties and activity that expire: sightings by cycle, then sessions of cycles.

A key is alive from its first sighting until ``window`` cycles pass without another one. A first windowed count leaves one row
for a key and cycle once the watermark has closed the cycle; a session window over those rows is the lifetime and is given out
when the watermark shows that it is over, so a key that falls silent is reported and forgotten without any further input.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def timed_state(spark: SparkSession):
    """Keys and their open cycles are kept in the RocksDB state store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def lifetimes(events: DataFrame, keys: Sequence[str], window: int, origin: str, cycle_ms: int = DAY_MS, delay: str = "1 hour") -> DataFrame:
    """Lifetimes ``(keys…, first, last)`` of every combination of ``keys`` in a stream with instants ``ts``.

    Sightings may come in any order within ``delay``; one whose cycle the watermark has closed is dropped. Rows with a null key
    are left out. Sightings of one cycle are one.
    """
    keys = list(keys)
    spark = events.sparkSession
    origin_ms = int(spark.sql(f"SELECT unix_millis(CAST('{origin} 00:00:00' AS TIMESTAMP)) AS t").first()["t"])
    rows = events.withWatermark("ts", delay).dropna(subset=[*keys, "ts"])
    cycle = F.window("ts", f"{cycle_ms} milliseconds", startTime=f"{origin_ms % cycle_ms} milliseconds")
    seen = rows.groupBy(*keys, cycle.alias("seen")).agg(F.count(F.lit(1)).alias("n"))  # a row as its cycle closes
    # the instant of a sighting is the last microsecond of its cycle: a lifetime ends ``window`` cycles after its last one began
    gap = F.session_window(F.window_time("seen"), f"{(window - 1) * cycle_ms * 1000 + 1} microseconds")
    lives = seen.groupBy(*keys, gap.alias("life")).agg(F.min("seen.start").alias("begun"), F.max("seen.start").alias("latest"))
    return lives.select(*keys, *[F.floor((F.unix_millis(x) - F.lit(origin_ms)) / cycle_ms).cast("int").alias(y) for x, y in (("begun", "first"), ("latest", "last"))])
