"""Helpers shared by the operators: tables, stored intermediates, ordinals, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.session import shared_dir


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started. A cluster without the same folders gets
    the package from its own installation or from ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and any executor can read it.
    ``by`` names columns that get a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and broadcast tables that nothing refers to any more: it acts when the driver's JVM
    collects garbage, which a driver with little to do puts off while executors' disks fill."""
    spark.sparkContext._jvm.System.gc()


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to at most ``most``; a larger single item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ordinals(df: DataFrame, key: str, order: Sequence[str], out: str = "ordinal", rows_per_part: int = 200_000) -> DataFrame:
    """Number the rows of every key from 0, in hash parts of a key followed by ``order``.

    A key with a third of all rows is numbered in many tasks: the parts' counts are added up first (one row for each
    key and part) and each part is ordered by itself. ``df`` should be stored; it is read twice.
    """
    parts = max(8, -(-df.count() // rows_per_part))
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = salted.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(starts, [key, "_part"]).withColumn(
        out, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def components(links: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the smallest node reachable.

    Each round a node takes the smallest label around it, offers it to its former label, and follows its label's
    label. Rounds end when no label moves; each is written to the shared folder, so a lost executor repeats one.
    Exchanged rows are (node, label) pairs and map-side minima, so a hub costs one row per task and neighbour.
    """
    both = stored(links.select(F.explode(F.array(F.struct(F.col(src).alias("u"), F.col(dst).alias("v")),
                                                 F.struct(F.col(dst).alias("u"), F.col(src).alias("v")))).alias("e"))
                  .select("e.u", "e.v").where("u <> v").distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        offers = seen.select("node", "old", "new").union(seen.select(F.col("old"), F.lit(None).cast("long"), "new"))
        hooked = offers.groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = stored(hooked.join(jump, "new").select("node", F.col("further").alias("label"), (F.col("further") != F.col("old")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def held_by_key(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each key; rows without a match get nulls.

    Keys that hold more than one in ``share`` of all rows are fewer than ``share``: their values are broadcast, and only
    the other rows are shuffled. So no key fills a task. Both tables should be stored; ``rows`` is read four times.
    """
    total = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(values.join(counts.where(F.col("_n") * share > total).select(key), key, "left_semi"))
    names = [c for c in values.columns if c != key]
    if hot.isEmpty():
        return rows.join(values, key, "left")
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = flagged.where(F.col("_hot").isNull()).drop("_hot", *names).join(values, key, "left")
    return flagged.where("_hot").drop("_hot").unionByName(rest.select(key, *[c for c in rows.columns if c != key], *names))


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
