"""Multiplicity adjustment, ranks and rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def adjust_p(tests: DataFrame, by: Sequence[str], p: str = "p", tie: Sequence[str] = ()) -> DataFrame:
    """Add ``holm_p`` and ``bh_p`` within each enumerated family ``by``."""
    family = W.partitionBy(*by)
    order = family.orderBy(p, *tie)
    n = F.count(F.lit(1)).over(family)
    ranked = tests.withColumns({"_r": F.row_number().over(order), "_n": n})
    holm = F.max((F.col("_n") - F.col("_r") + 1) * F.col(p)).over(order.rowsBetween(W.unboundedPreceding, 0))
    bh = F.min(F.col("_n") * F.col(p) / F.col("_r")).over(order.rowsBetween(0, W.unboundedFollowing))
    return ranked.withColumns({
        "holm_p": F.least(F.lit(1.0), holm), "bh_p": F.least(F.lit(1.0), bh)}).drop("_r", "_n")


def cumulative_below(counts: DataFrame, by: Sequence[str], x: str, measures: Sequence[str],
                     buckets: int | None = None) -> DataFrame:
    """Add ``below_<m>``: the sum of ``m`` over the strictly smaller ``x`` of the same group.

    ``counts`` has one row per distinct ``x``. With ``buckets`` the range of ``x`` in each group is cut into that
    many equal parts, bucket totals are added up first and only the inside of a bucket is ordered, so a group with
    very many distinct values is not sorted by one task.
    """
    by = list(by)
    if buckets is None:
        w = W.partitionBy(*by).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumns({f"below_{m}": F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures})
    span = counts.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = counts.join(span, by).withColumn("_b", F.floor(share * (buckets - 1))).drop("_lo", "_hi")
    upto = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{m}").over(upto), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = W.partitionBy(*by, "_b").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumns({f"_i_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    out = ranked.join(offsets, [*by, "_b"])
    return out.select(*counts.columns, *[(F.col(f"_o_{m}") + F.col(f"_i_{m}")).alias(f"below_{m}") for m in measures])


def distinct_ranks(df: DataFrame, by: Sequence[str], x: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Mid-ranks of every distinct value: rows ``(by…, x, n, rank)``.

    Values are counted before they are ordered, so ties never travel as rows.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    below = cumulative_below(counts, by, x, ["n"], buckets)
    return below.withColumn(out, F.col("below_n") + (F.col("n") + 1) / 2).drop("below_n")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Spearman correlation with mid-ranks per group: rows ``(by…, n, rho)``, NULL for a constant side."""
    by = list(by)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    ranks = lambda c, name: cumulative_below(
        both.groupBy(*by, c).agg(F.sum("_w").alias("n")), by, c, ["n"], buckets
    ).select(*by, c, (F.col("below_n") + (F.col("n") + 1) / 2).alias(name))
    joined = both.join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    num = F.sum(w * a * b) - sa * sb / n
    den = F.sqrt((F.sum(w * a * a) - sa * sa / n) * (F.sum(w * b * b) - sb * sb / n))
    return joined.groupBy(*by).agg(n.alias("n"), F.try_divide(num, den).alias("rho"))


def auc(df: DataFrame, by: Sequence[str], score: str, positive: Column, buckets: int | None = None) -> DataFrame:
    """Probability that a positive outscores a negative, ties half; NULL scores dropped, NULL if a side is empty.

    Counted per distinct score: with cumulative negatives below each score the pairs need not be formed.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    placed = cumulative_below(counts, by, score, ["neg"], buckets)
    won = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    return (placed.withColumn("_won", won).groupBy(*by)
            .agg(F.try_divide(F.sum("_won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))


def guarded_corr(x: str, y: str, min_n: int = 4) -> Column:
    """Aggregate: Pearson correlation, NULL below ``min_n`` joint points or for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    usable = (F.count(a) >= min_n) & (F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12)
    return F.when(usable, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def mean_test(x: str) -> dict[str, Column]:
    """Aggregates of the normal test that the mean is zero: n, difference, se and Wald interval, and z.

    A constant sample has no standard error: z is NULL and the caller's p is 1 for a zero mean, else 0.
    """
    from tidewatch.functions.intervals import Z95
    m, se = F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))
    return {"n": F.count(x), "difference": m, "se": se, "z": F.when(se > 0, m / se),
            "lo95": m - Z95 * se, "hi95": m + Z95 * se}
