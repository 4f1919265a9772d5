"""Adapters from the raw tables to per-cycle series and event logs.

A *run* is one key whose measures are followed over integer cycles. Each adapter aggregates once, with map-side
partial aggregation, before anything is ordered: however many raw rows a hot key has, it leaves at most one row
per cycle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import day_cycle, finite, hour_cycle, unit_hash

# Fixed values of the adapters: origins and lengths of the cycle axes.
EVENT_ORIGIN = "2024-01-01"
EVENT_HOURS = 720
SHIP_ORIGIN = "1995-01-01"
SHIP_CYCLE_DAYS = 14
SHIP_CYCLES = 179
ORDER_ORIGIN = "1995-01-01"
ORDER_DAYS = 2405


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def densify(df: DataFrame, keys: Sequence[str], n_cycles: int, cycle: str = "cycle") -> DataFrame:
    """One row per key and cycle 0..n-1; missing cycles carry NULL measures.

    Every observed row also emits the empty cycles up to the next observed one, so no spine table is joined:
    the only exchange is the one on ``keys`` that the window operators after it need anyway. Rows outside the declared
    axis take no part; :func:`outside_axis` counts them, and the query ``axis_remainder`` reports them.
    """
    df = df.where((F.col(cycle) >= 0) & (F.col(cycle) < n_cycles))
    by_key = W.partitionBy(*keys).orderBy(cycle)
    values = [c for c in df.columns if c not in keys and c != cycle]
    first = F.when(F.lag(cycle).over(by_key).isNull(), F.lit(0)).otherwise(F.col(cycle))
    until = F.coalesce(F.lead(cycle).over(by_key), F.lit(n_cycles)) - 1
    wide = df.withColumn("_from", first).withColumn("_to", until)
    cells = wide.withColumn("_cycle", F.explode(F.sequence("_from", "_to")))
    here = F.col("_cycle") == F.col(cycle)
    return cells.select(
        *keys, F.col("_cycle").cast("int").alias(cycle),
        *[F.when(here, F.col(v)).alias(v) for v in values],
    )


def outside_axis(cycle: Column, n_cycles: int) -> Column:
    """Aggregate: rows whose cycle lies outside the declared axis 0..n-1."""
    return F.count_if((cycle < 0) | (cycle >= n_cycles))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean and count of ``value`` per event type."""
    ev = table(spark, sf_dir, "events", "event_type", "ts", "value")
    cells = (
        ev.withColumn("cycle", hour_cycle("ts", EVENT_ORIGIN))
        .groupBy("event_type", "cycle")
        .agg(F.avg(finite("value")).alias("y"), F.count(finite("value")).alias("n"), F.sum(finite("value")).alias("s"))
    )
    return densify(cells, ["event_type"], EVENT_HOURS)


def supplier_cells(spark: SparkSession, sf_dir: str, coverage: float | None = None) -> DataFrame:
    """Fortnightly measures per supplier and scenario before densification.

    ``form`` and ``esc`` are the two watched classes, ``out`` the lagging output. With ``coverage`` only lines
    of visible parts count towards ``form`` and ``esc``; the lagging output never passes through the mask.
    """
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_linestatus", "l_shipdate",
               "l_quantity", "l_discount", "l_extendedprice")
    seen = F.lit(True) if coverage is None else unit_hash("part", "l_partkey") < coverage
    return (
        li.withColumn("cycle", day_cycle("l_shipdate", SHIP_ORIGIN, SHIP_CYCLE_DAYS))
        .withColumn("scen", F.when(F.col("l_linestatus") == "F", "degrade").otherwise("control"))
        .groupBy(F.col("l_suppkey").alias("run"), "scen", "cycle")
        .agg(
            F.avg(F.when(seen, finite("l_quantity"))).alias("form"),
            F.avg(F.when(seen, finite("l_discount") * 100)).alias("esc"),
            F.avg(finite("l_extendedprice") / 1000).alias("out"),
        )
    )


def supplier_series(spark: SparkSession, sf_dir: str, coverage: float | None = None) -> DataFrame:
    return densify(supplier_cells(spark, sf_dir, coverage), ["run", "scen"], SHIP_CYCLES)


# ------------------------------------------------------------------ SQL text of the same adapters
EVENT_HOURS_SQL = f"""
event_cells AS (
  SELECT event_type, date_diff('day', DATE '{EVENT_ORIGIN}', CAST(ts AS DATE)) * 24 + hour(ts) AS cycle,
         avg(value) AS y, count(value) AS n, sum(value) AS s
  FROM events GROUP BY 1, 2),
event_hours AS (
  SELECT k.event_type, CAST(t.range AS BIGINT) AS cycle, c.y, c.n, c.s
  FROM (SELECT DISTINCT event_type FROM event_cells) k CROSS JOIN range({EVENT_HOURS}) t
  LEFT JOIN event_cells c ON c.event_type = k.event_type AND c.cycle = t.range)"""


def unit_hash_sql(tag: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{tag}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def supplier_series_sql(coverage: float | None = None, name: str = "series") -> str:
    seen = "TRUE" if coverage is None else f"{unit_hash_sql('part', 'l_partkey')} < {coverage}"
    return f"""
{name}_cells AS (
  SELECT l_suppkey AS run, CASE WHEN l_linestatus = 'F' THEN 'degrade' ELSE 'control' END AS scen,
         CAST(floor(date_diff('day', DATE '{SHIP_ORIGIN}', CAST(l_shipdate AS DATE)) / {SHIP_CYCLE_DAYS}) AS INTEGER) AS cycle,
         avg(CASE WHEN {seen} THEN l_quantity END) AS form,
         avg(CASE WHEN {seen} THEN l_discount * 100 END) AS esc,
         avg(l_extendedprice / 1000) AS out
  FROM lineitem GROUP BY 1, 2, 3),
{name} AS (
  SELECT k.run, k.scen, CAST(t.range AS INTEGER) AS cycle, c.form, c.esc, c.out
  FROM (SELECT DISTINCT run, scen FROM {name}_cells) k CROSS JOIN range({SHIP_CYCLES}) t
  LEFT JOIN {name}_cells c ON c.run = k.run AND c.scen = k.scen AND c.cycle = t.range)"""
