"""Jobs that hold result tables against each other: an empty difference is the pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """Equal within an absolute plus relative tolerance; NULL equals only NULL."""
    return F.coalesce(F.abs(a - b) <= tol + tol * F.greatest(F.abs(a), F.abs(b)), F.lit(False)) | (a.isNull() & b.isNull())


def recompute_differences(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], values: Sequence[str],
                          tol: float = 1e-9) -> DataFrame:
    """Cells that differ or that one side lacks: rows ``(keys…, field, stored, fresh, problem)``."""
    a = stored.select(*keys, F.lit(True).alias("_a"), *[F.col(v).cast("double").alias(f"a_{v}") for v in values])
    b = fresh.select(*keys, F.lit(True).alias("_b"), *[F.col(v).cast("double").alias(f"b_{v}") for v in values])
    j = a.join(b, list(keys), "full")
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"a_{v}").alias("stored"), F.col(f"b_{v}").alias("fresh")) for v in values]))
    d = j.select(*keys, "_a", "_b", rows.alias("r")).select(*keys, "_a", "_b", "r.*")
    problem = (F.when(F.col("_a").isNull(), "only fresh").when(F.col("_b").isNull(), "only stored")
               .when(~close(F.col("stored"), F.col("fresh"), tol), "differs"))
    return d.withColumn("problem", problem).where("problem IS NOT NULL").drop("_a", "_b")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows one table has more often than the other: rows ``(columns…, surplus)``, positive for ``a``.

    One grouped union instead of two set differences.
    """
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def seed_hygiene(df: DataFrame, by: Sequence[str], seed: str) -> DataFrame:
    """Range, uniqueness and contiguity of the seeds of each block."""
    n, d = F.count(seed), F.count_distinct(seed)
    return df.groupBy(*by).agg(
        n.alias("n"), d.alias("n_distinct"), F.min(seed).alias("lo"), F.max(seed).alias("hi"), (n == d).alias("unique"),
        (F.max(seed) - F.min(seed) + 1 == d).alias("contiguous"))


def shared_seeds(df: DataFrame, block: str, seed: str) -> DataFrame:
    """Seeds that occur in more than one block."""
    return df.groupBy(seed).agg(F.count_distinct(block).alias("n_blocks")).where("n_blocks > 1")


def sum_to_whole(df: DataFrame, parts: Sequence[str], whole: str, tol: float = 1e-9) -> DataFrame:
    """Rows whose parts do not add up."""
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return df.withColumn("gap", F.abs(total - F.col(whole))).where(F.col("gap") > tol)


def declared_values(df: DataFrame, by: Sequence[str], field: str, declared: Column) -> DataFrame:
    """Variants whose rows do not all carry the declared value."""
    return df.groupBy(*by).agg(F.min(field).alias("lo"), F.max(field).alias("hi"), F.max(declared).alias("declared")).where(
        (F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("declared")))


def bind_claims(claims: DataFrame, table: DataFrame, keys: Sequence[str], value: str, tol: str = "tolerance") -> DataFrame:
    """Quoted numbers beside the cells they quote; a claim has to match exactly one row and lie within its tolerance."""
    found = claims.join(table.select(*keys, F.col(value).cast("double").alias("_v")), list(keys), "left")
    g = found.groupBy("claim", "quoted", tol).agg(F.count("_v").alias("matches"), F.max("_v").alias("actual"))
    return g.withColumn("holds", (F.col("matches") == 1) & (F.abs(F.col("actual") - F.col("quoted")) <= F.col(tol)))
