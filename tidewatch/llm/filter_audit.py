"""Filter interaction audit: what each quality filter removes, in every order the filters could run in.

A document is reduced to a mask, one bit for each filter it fails, and the masks are counted for each part with the labels
beside them: at most 2^k cells a part. All subsets of filters are then walked in Gray-code order, so each step toggles one
filter. Every mask cell keeps a counter of the active filters it fails; a cell whose counter leaves zero is subtracted from the
running survivors and one whose counter returns to zero is added back. The survivors of all 2^k subsets are stored, and any
step of any order is a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Characters between words, and those filter D looks for.
BLANKS = " \t\n\x0b\x0c\r"
MARKS = "[#$%&*|]"
#: What is counted for each part: all documents, good ones, toxic ones.
COUNTED = ("n", "good", "toxic")
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
         "toxic_lost long, shapley long")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides; ``text`` is not null. Comparisons are of whole numbers."""
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, A in the lowest bit, E in the highest.

    Equal texts are told by their SHA-256. Rows are counted for each (text, part, labels) before the first one of a text is
    looked for, so a text that a third of the rows share is a few rows by then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = text_filters(text)
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(alone.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"))
    # rows without an id have no label; they are dealt by their text
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("same")).otherwise(F.lit(0)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("salt")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    own = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    marked = salted.join(marks, ["id", "salt"], "left").select("id", "part", "mask", "same", *own)
    # the smallest id of a group and how often it occurs there: those rows, and rows without an id, are no copies
    low = F.min("id")
    cells = stored(marked.groupBy("same", "part", "mask", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("k"))
                   .groupBy("same", "part", "mask", "good", "toxic")
                   .agg(F.sum("k").alias("n"), low.alias("low"), F.min_by("k", "id").alias("n_low"),
                        F.sum(F.when(F.col("id").isNull(), F.col("k")).otherwise(0)).alias("n_null")))
    first = cells.groupBy("same").agg(F.min("low").alias("first"))
    at = cells.join(first, "same").withColumn(
        "passing", F.col("n_null") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0))
    split = at.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct((F.col("mask") + (1 << len(alone))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; ``cells`` has the parts' counts by mask on its last axis, and so has the result by
    subset (bit i: filter i is on)."""
    size = cells.shape[-1]
    k = size.bit_length() - 1
    failing = np.zeros(size, dtype=np.int64)
    alive = cells.sum(axis=-1)
    states = np.empty(cells.shape, dtype=np.int64)
    states[..., 0] = alive
    holds = [np.flatnonzero(np.arange(size) >> i & 1) for i in range(k)]
    subset = 0
    for walked in range(1, size):
        i = (walked & -walked).bit_length() - 1
        subset ^= 1 << i
        if subset >> i & 1:
            failing[holds[i]] += 1
            lost = holds[i][failing[holds[i]] == 1]
            alive = alive - cells[..., lost].sum(axis=-1)
        else:
            failing[holds[i]] -= 1
            back = holds[i][failing[holds[i]] == 0]
            alive = alive + cells[..., back].sum(axis=-1)
        states[..., subset] = alive
    return states


def steps(parts: Sequence[str], states: np.ndarray, names: str) -> pd.DataFrame:
    """Every step of every order for ``parts``; ``states`` is (part, counted, subset)."""
    k, n = len(names), states[:, 0]
    everything = (1 << k) - 1
    weight = [factorial(s) * factorial(k - 1 - s) for s in range(k)]
    shapley = {i: sum(weight[s.bit_count()] * (n[:, s] - n[:, s | 1 << i]) for s in range(1 << k) if not s >> i & 1) for i in range(k)}
    out = []
    for order in permutations(range(k)):
        before, name = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = states[:, :, before] - states[:, :, after]
            out.append(pd.DataFrame({
                "part": parts, "filter_order": name, "step": step, "kept": n[:, after], "removed": gone[:, 0],
                "redundant": n[:, 0] - n[:, 1 << i] - gone[:, 0], "unique_fails": n[:, everything ^ 1 << i] - n[:, everything],
                "good_lost": gone[:, 1], "toxic_lost": gone[:, 2], "shapley": shapley[i]}))
            before = after
    return pd.concat(out, ignore_index=True).astype({"step": "int32"})


def audit(docs: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part of
    ``docs`` (doc_id, text, source; other columns ignored), each order of the filters and each step.

    A null text is the empty one, which has no words (A fails, B and C pass). A null source is the empty part. A row without
    doc_id has no label and is no copy; the others are copies of it only if a smaller id has their text. Rows that repeat an id
    with the same text are not copies of each other; each is counted. A document is good or toxic if any of its label rows says
    so. No documents: no rows.
    """
    size = 1 << len(names)
    cell = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED))))  # at most 2^k entries
    rows = masks(docs, labels).groupBy("part").agg(cell.alias("m"))

    def by_mask(counted: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i)[counted], F.lit(0).cast("long"))).alias(counted)

    table = rows.select("part", *[by_mask(c) for c in COUNTED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 100):
                some = b.iloc[lo:lo + 100]
                cells = np.stack([np.stack(some[c].to_numpy()) for c in COUNTED], axis=1).astype(np.int64)
                yield steps(some["part"].tolist(), survivors(cells), names)

    return table.mapInPandas(run, STEPS)
