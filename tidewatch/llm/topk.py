"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every row. Histograms of the scores, kept from the top down to each partition's own k-th
value, are added up over all partitions; the bin that holds a query's k-th best score is refined with narrower bins
until it is one value wide. A last pass keeps the scores above that value and, of those equal to it, the smallest ids.
What leaves a task is at most k bins, then 2 k rows, for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import stored

#: Bytes of query vectors handed to tasks at once; more queries take more passes.
QUERY_BYTES = 16 << 20
#: Scores held by a task at once.
BLOCK_SCORES = 4_000_000
#: Component sizes up to which a sum of products is exact in doubles.
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of each component; rows with a null vector, a null or non-finite component or
    a null id are left out. Vectors of several lengths are searched apart from each other."""
    x = F.col("x").cast("double")
    good = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~good).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in column], dtype=np.int64)


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, rows by queries. Exact while they fit in 64 bits: by double arithmetic where a bound on
    the sums shows that it is exact, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (rows.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return rows @ q.T


def scored(batches: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, scores rows by queries, whether the row is the query itself) in blocks of bounded size."""
    step = max(1, BLOCK_SCORES // max(1, len(ids)))
    for b in batches:
        b = b[b["v"].map(len) == q.shape[1]]
        for lo in range(0, len(b), step):
            part = b.iloc[lo:lo + step]
            own = part["vec_id"].to_numpy()
            yield own, products(q, matrix(part["v"])), own[:, None] == ids[None, :]


def top_bins(bins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``bins`` from the top until k are counted, with their counts."""
    value, n = np.unique(bins, return_counts=True)
    value, n = value[::-1], n[::-1]
    upto = int(np.searchsorted(np.cumsum(n), k)) + 1
    return value[:upto], n[:upto]


def kth_values(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, bins: int) -> np.ndarray:
    """The k-th best score of each query (the lowest, if there are fewer rows)."""
    n = len(ids)
    # below this no score lies, whatever the rows: found from the largest component, one number
    largest = rows.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    bound = int(np.abs(q).sum(axis=1).max(initial=0)) * int(largest) + 1
    width = 1
    while 2 * bound // width > bins:
        width *= bins
    floor, need, span = np.full(n, -bound, np.int64), np.full(n, k, np.int64), np.full(n, 2 * bound, np.int64)
    while True:
        held, wanted, reach, step = floor.copy(), need.copy(), span.copy(), width

        def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for _, score, same in scored(batches, ids, q):
                at = (score - held) // step
                out = same | (score < held) | (score >= held + reach)
                at[out] = -1
                keep = min(k + 1, len(at))
                part = -np.partition(-at, keep - 1, axis=0)[:keep]  # a bin among the k best of the block, at least
                for j in range(n):
                    edge = part[:, j].min()
                    b = at[:, j][at[:, j] >= max(edge, 0)]
                    if len(b):
                        value, count = top_bins(b, int(wanted[j]))
                        if j in best:
                            value, inverse = np.unique(np.concatenate([best[j][0], value]), return_inverse=True)
                            count = np.bincount(inverse, np.concatenate([best[j][1], count])).astype(np.int64)
                            value, count = value[::-1], count[::-1]
                            upto = int(np.searchsorted(np.cumsum(count), wanted[j])) + 1
                            value, count = value[:upto], count[:upto]
                        best[j] = value, count
            for j, (value, count) in best.items():
                yield pd.DataFrame({"q": j, "bin": value, "n": count})

        local = rows.mapInPandas(histogram, "q int, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        need_of = stored_map(rows, wanted)
        reached = local.withColumn("above", above).join(need_of, "q").where(F.col("above") < F.col("need"))
        got = reached.groupBy("q").agg(F.min(F.struct("bin", "above")).alias("m")).select("q", "m.bin", "m.above").toPandas()
        at, b = got["q"].to_numpy(), got["bin"].to_numpy()
        floor[at] = held[at] + b * step
        need[at] = wanted[at] - got["above"].to_numpy()
        if step == 1:
            return floor
        span[:] = step
        width = max(1, step // bins)


def stored_map(rows: DataFrame, need: np.ndarray) -> DataFrame:
    return rows.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(len(need), dtype=np.int32), "need": need}))


def search(queries: DataFrame, rows: DataFrame, k: int = 5, bins: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query but itself, ties to the smaller vec_id.

    ``queries`` and ``rows`` are (vec_id, v) as :func:`quantised` makes them; ids are unique. A query with fewer rows
    gets all of them; an empty side gives no rows. Queries are taken in groups of QUERY_BYTES, each a full pass.
    """
    spark = rows.sparkSession
    rows = stored(rows)
    placed = stored(queries.withColumn("dim", F.size("v")))
    out = None
    for dim, n in sorted((r[0], r[1]) for r in placed.groupBy("dim").count().collect()):
        groups = max(1, -(-n * dim * 8 // QUERY_BYTES))
        for g in range(groups):
            part = placed.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)).toPandas().sort_values("vec_id")
            if len(part) and dim:
                found = search_group(rows, part["vec_id"].to_numpy(), matrix(part["v"]), k, bins)
                out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def search_group(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, bins: int) -> DataFrame:
    kth = kth_values(rows, ids, q, k, bins)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, score, same in scored(batches, ids, q):
            row, col = np.nonzero((score >= kth) & ~same)
            hit = pd.DataFrame({"query_id": ids[col], "vec_id": own[row], "score": score[row, col], "tied": score[row, col] == kth[col]})
            ties = hit[hit["tied"]].sort_values("vec_id").groupby("query_id").head(k)
            yield pd.concat([hit[~hit["tied"]], ties]).drop(columns="tied")

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = rows.mapInPandas(pick, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
