"""The event log with membership: an order is a team event, its suppliers are the members, its date the cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import day_cycle, unit_hash
from tidewatch.sources.tables import ORDER_DAYS, ORDER_ORIGIN, table, unit_hash_sql

# Fixed values of the team graph.
TIE_WINDOW = 20
LINK_WINDOW = 20
COVERAGE = 0.6
PROGRAM_DAYS = 14
# A prime, so that scaled means do not end in an exact half that engines would round apart.
VALUE_SCALE = 997


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows ``(team, cycle, node)``."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").distinct()
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("team"), day_cycle("o_orderdate", ORDER_ORIGIN).alias("cycle"), F.col("l_suppkey").alias("node"))


def team_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(team, cycle, level, urgent, value)``: one per order."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice").select(
        F.col("o_orderkey").alias("team"), day_cycle("o_orderdate", ORDER_ORIGIN).alias("cycle"),
        F.col("o_orderpriority").alias("level"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        (F.col("o_totalprice") / VALUE_SCALE).alias("value"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("node"))


def visible(coverage: float = COVERAGE, node: str = "node"):
    """Missing completely at random: a node is seen iff its reproducible uniform number is below the coverage."""
    return unit_hash("supplier", node) < coverage


MEMBERS_SQL = f"""
members AS (SELECT DISTINCT o_orderkey AS team, CAST(date_diff('day', DATE '{ORDER_ORIGIN}', CAST(o_orderdate AS DATE)) AS INTEGER) AS cycle, l_suppkey AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EVENTS_SQL = f"""
team_events AS (SELECT o_orderkey AS team, CAST(date_diff('day', DATE '{ORDER_ORIGIN}', CAST(o_orderdate AS DATE)) AS INTEGER) AS cycle, o_orderpriority AS level,
  o_orderpriority = '1-URGENT' AS urgent, o_totalprice / {VALUE_SCALE} AS value FROM orders)"""
VISIBLE_SQL = f"{unit_hash_sql('supplier', 'node')} < {COVERAGE}"
__all__ = ["members", "team_events", "nodes", "visible", "ORDER_DAYS"]
