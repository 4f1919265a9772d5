"""Bootstrap and permutation over independent groups, with draws as rows.

Everything drawn is computed from (seed, draw, place), so a lost task redoes the same draws and any engine can repeat them.
A bootstrap deals its slots in pieces and sends each to the block of its row. A permutation computes where a row goes.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import MIX_MODULUS, MIX_MULTIPLIER, mixed, mixed_sql, unit_digits
from tidewatch.session import cut_lineage

# A value table up to this many rows (a few tens of MB at most) may be copied to every executor.
BROADCAST_ROWS = 500_000
# Rows of a stratum that a task resamples together.
BLOCK = 4096
# Slots that a task deals at once.
AT_ONCE = 1 << 20
# Rows of a stratum that may be numbered together.
NUMBERED = 20_000
# Strides of the slot number, primes.
DRAW_STRIDE = 1000003
SLOT_STRIDE = 7919
ROUND_STRIDE = 104729
# Rounds of the keyed bijection.
ROUNDS = 6


# Cumulative Poisson(1) probabilities for 0..12; what is left, 6e-11, is below the resolution of the hash.
POISSON_CDF = list(accumulate(exp(-1) / factorial(k) for k in range(13)))


def slot_number(seed: int, draw: Column, slot: Column) -> Column:
    return mixed(F.lit(seed).cast("bigint") + draw.cast("bigint") * DRAW_STRIDE + slot.cast("bigint") * SLOT_STRIDE)


def slot_number_sql(seed: int, draw: str, slot: str) -> str:
    return mixed_sql(f"({seed} + CAST({draw} AS BIGINT) * {DRAW_STRIDE} + CAST({slot} AS BIGINT) * {SLOT_STRIDE})")


def slot_numbers(seed: int, draws: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """:func:`slot_number` for arrays."""
    x = ((seed + draws * DRAW_STRIDE + slots * SLOT_STRIDE) * MIX_MULTIPLIER + 12345) % MIX_MODULUS
    for _ in range(3):
        x = ((x * x) % MIX_MODULUS + x * MIX_MULTIPLIER) % MIX_MODULUS
    return x


def dense_index(df: DataFrame, strata: Sequence[str], key: str, out: str = "idx") -> DataFrame:
    """Number the rows of each stratum 0..n-1 in the order of md5(key).

    Rows are numbered in hash buckets of about ``NUMBERED`` rows whose offsets are running counts, so no stratum is ordered
    in one task. ``df`` should be materialised; it is counted first.
    """
    digits, n_rows = 0, df.count()
    while NUMBERED * 16 ** digits < n_rows:
        digits += 1
    df = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    if not digits:
        return df.withColumn(out, (F.row_number().over(W.partitionBy(*strata).orderBy("_h")) - 1).cast("bigint")).drop("_h")
    df = df.withColumn("_b", F.substring("_h", 1, digits))
    upto = W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_h")) - 1
    return (df.withColumn("_i", inside).join(offsets, [*strata, "_b"])
            .withColumn(out, (F.col("_offset") + F.col("_i")).cast("bigint")).drop("_h", "_b", "_i", "_offset"))


def _small(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def block_counts(seed: int, stratum: str, n: int, block: int, draws: int, size: int = BLOCK) -> np.ndarray:
    """How many of the n slots of each draw fall on the rows of ``block``, of a stratum of n rows cut into blocks.

    The blocks are the leaves of a binary tree. At each node the slots that reached it are split between its halves by a
    binomial number, drawn from a generator that (seed, stratum, node) fixes; so every task that follows a path meets the
    same numbers, the counts of all blocks add up to n in every draw, and no task draws more than its own path.
    """
    own = xxhash.xxh3_64_intdigest(f"{seed}|{stratum}".encode())
    lo, hi, node = 0, -(-n // size), 1
    slots = np.full(draws, n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = (mid - lo) * size / (min(hi * size, n) - lo * size)
        left = np.random.Generator(np.random.Philox(key=np.array([own, node], dtype=np.uint64))).binomial(slots, share)
        if block < mid:
            hi, node, slots = mid, 2 * node, left
        else:
            lo, node, slots = mid, 2 * node + 1, slots - left
    return slots


def dealt_slots(n: int, seed: int, draws: range, slots: range, size: int = BLOCK) -> list[tuple[int, bytes, bytes]]:
    """The rows that ``slots`` of ``draws`` fall on, by block: ``(block, slots of each draw, their rows within the block)``."""
    draw = np.repeat(np.arange(draws.start, draws.stop), len(slots))
    idx = slot_numbers(seed, draw, np.tile(np.arange(slots.start, slots.stop), len(draws))) % n
    block = idx // size
    order = np.argsort(block, kind="stable")  # a block's slots stay in the order of their draws
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    out = []
    for some in np.split(order, cuts[1:]):
        own = int(block[some[0]])
        per_draw = np.bincount(draw[some] - draws.start, minlength=len(draws))
        out.append((own, per_draw.astype("<u4").tobytes(), (idx[some] - own * size).astype("<u2").tobytes()))
    return out


def bootstrap_sums(values: DataFrame, strata: Sequence[str], key: str, columns: Sequence[str], draws: int,
                   seed: int, size: int = BLOCK) -> DataFrame:
    """Sums of ``columns`` over each resample with replacement: rows ``(strata…, draw, n, <columns>)``.

    ``values`` holds one row per independent group. Slot t of a draw falls on row ``slot_number(seed, draw, t) % n`` of its
    stratum, however long that is. The n slots of all draws are dealt in pieces of at most ``AT_ONCE`` and sent, two bytes
    each, to the block of ``size`` rows they fall on; the task of a block adds up its own slots and sends one sum a draw. So
    no task holds more than a piece or a block, and a long stratum is many tasks. NULL values add nothing; a sum without any
    value is NULL. Rows of a NULL stratum take no part.
    """
    strata, columns = list(strata), list(columns)
    if not 0 < size <= 1 << 16:
        raise ValueError("a row's place within its block has two bytes")
    base = cut_lineage(values.select(*strata, key, *columns).dropna(subset=strata))
    rows = dense_index(base, strata, key).drop(key).withColumn("_block", F.floor(F.col("idx") / size))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    of_strata = [f"`{s}` {kinds[s]}" for s in strata]
    sizes = base.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    # a piece has all slots of some draws or, of a stratum longer than a piece, some slots of one draw
    first = lambda length, step: F.explode(F.sequence(F.lit(0).cast("bigint"), length - 1, step))
    n_draws = F.lit(draws).cast("bigint")
    pieces = (sizes.withColumn("_draws", F.greatest(F.lit(1), F.floor(AT_ONCE / F.col("n")))).withColumn("_draw", first(n_draws, F.col("_draws")))
              .withColumn("_slot", first(F.col("n"), F.lit(AT_ONCE).cast("bigint"))))
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(frames):
        for frame in frames:
            for piece in frame.itertuples(index=False):
                *own, n, some, draw, slot = piece
                parts = dealt_slots(n, seed, range(draw, min(draw + some, draws)), range(slot, min(slot + AT_ONCE, n)), size)
                out = {s: [v] * len(parts) for s, v in zip(strata, own)}
                out |= {"n": n, "_draw": draw, "_slot": slot}
                yield pd.DataFrame(out | dict(zip(("_block", "_per_draw", "_rows"), zip(*parts))))

    def add_up(held: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        if not len(dealt):
            return pd.DataFrame()
        x = held.sort_values("idx")[columns].astype(float).to_numpy()
        known = ~np.isnan(x)
        x, sums, found = np.nan_to_num(x), np.zeros((draws, len(columns))), np.zeros((draws, len(columns)))
        for r in dealt.sort_values(["_draw", "_slot"]).itertuples(index=False):
            *_, lo, _slot, _block, per_draw, row = r
            per_draw, row = np.frombuffer(per_draw, "<u4"), np.frombuffer(row, "<u2")
            here = np.repeat(np.arange(len(per_draw)), per_draw)
            for c in range(len(columns)):
                sums[lo:lo + len(per_draw), c] += np.bincount(here, x[row, c], len(per_draw))
                found[lo:lo + len(per_draw), c] += per_draw if known[:, c].all() else np.bincount(here, known[row, c], len(per_draw))
        out = {s: [dealt[s].iloc[0]] * draws for s in strata}
        out |= {"draw": np.arange(draws, dtype=np.int32), "n": np.full(draws, dealt["n"].iloc[0])}
        for i, c in enumerate(columns):
            out |= {c: sums[:, i], f"_k_{c}": found[:, i]}
        return pd.DataFrame(out)

    # AQE would join the pieces, which are short rows, into one task: their number of tasks is fixed
    slots = pieces.repartition(tasks).mapInPandas(deal, ", ".join([*of_strata, "n long, _draw long, _slot long, _block long, _per_draw binary, _rows binary"]))
    fields = ", ".join([*of_strata, "draw int", "n long", *(f"`{c}` double, `_k_{c}` double" for c in columns)])
    drawn = rows.groupBy(*strata, "_block").cogroup(slots.groupBy(*strata, "_block")).applyInPandas(add_up, fields)
    return drawn.groupBy(*strata, "draw").agg(F.max("n").alias("n"), *[F.when(F.sum(f"_k_{c}") > 0, F.sum(c)).alias(c) for c in columns])


def poisson_sums(values: DataFrame, strata: Sequence[str], key: str, columns: Sequence[str], draws: int,
                 seed: int) -> DataFrame:
    """Bootstrap with independent Poisson(1) weights, for tables too long to expand slot by slot.

    Rows are spread over all tasks, as a short file makes few; every row meets every draw once in its own task and the shuffle
    after that carries partial sums only. The weight comes from a hash of (seed, draw, key), so no two keys share their draws.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a text of eight hex digits compares as its number, which exceeds p * 2^32 if it exceeds the whole part of it
    u = unit_digits(f"poisson{seed}", "draw", key)
    weight = F.when(F.col("_u") <= f"{int(POISSON_CDF[0] * 2 ** 32):08x}", 0)
    for k, p in enumerate(POISSON_CDF[1:], 1):
        weight = weight.when(F.col("_u") <= f"{int(p * 2 ** 32):08x}", k)
    weight = weight.otherwise(len(POISSON_CDF))
    # no filter on the weight: it would be pushed below the hash and compute that anew for every comparison
    return (
        values.select(*strata, key, *columns).repartition(tasks)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", u)
        .withColumn("_w", weight).groupBy(*strata, "draw")
        .agg(F.sum("_w").alias("n"), *[F.sum(F.when(F.col("_w") > 0, F.col(c) * F.col("_w"))).alias(c) for c in columns])
        .where("n > 0")
    )


def percentile_interval(per_draw: DataFrame, strata: Sequence[str], stat: str) -> DataFrame:
    """Standard error and 95 % percentile interval of ``stat`` over draws; undefined draws are counted out."""
    return per_draw.groupBy(*strata).agg(
        F.stddev_samp(stat).alias("se"), F.expr(f"percentile({stat}, 0.025)").alias("lo95"),
        F.expr(f"percentile({stat}, 0.975)").alias("hi95"), F.count(stat).alias("n_resolved"))


def bootstrap_mean(values: DataFrame, strata: Sequence[str], key: str, x: str, draws: int, seed: int) -> DataFrame:
    """Mean, bootstrap standard error and percentile interval; NULL values are left out first."""
    known = values.where(F.col(x).isNotNull())
    sums = bootstrap_sums(known, strata, key, [x], draws, seed)
    per_draw = sums.withColumn("_mean", F.col(x) / F.col("n"))
    point = known.groupBy(*strata).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    interval = percentile_interval(per_draw, strata, "_mean").drop("n_resolved")
    return point.join(interval, list(strata))


def order_statistic_interval(per_draw: DataFrame, strata: Sequence[str], stat: str, draws: int,
                             upper_shift: int = 0) -> DataFrame:
    """Interval ends as sorted draws number ``int(.025 B)`` and ``int(.975 B) - upper_shift``, counted from 0."""
    w = W.partitionBy(*strata).orderBy(stat)
    ranked = per_draw.withColumn("_r", F.row_number().over(w) - 1)
    lo, hi = int(0.025 * draws), int(0.975 * draws) - upper_shift
    return ranked.groupBy(*strata).agg(
        F.max(F.when(F.col("_r") == lo, F.col(stat))).alias("lo95"),
        F.max(F.when(F.col("_r") == hi, F.col(stat))).alias("hi95"), F.stddev_samp(stat).alias("se"))


def round_key(seed: int, draw: Column) -> Column:
    return mixed(F.lit(seed).cast("bigint") + draw.cast("bigint") * DRAW_STRIDE)


def round_key_sql(seed: int, draw: str) -> str:
    return mixed_sql(f"({seed} + CAST({draw} AS BIGINT) * {DRAW_STRIDE})")


def with_keyed_place(df: DataFrame, idx: str, n: str, key: str, out: str) -> DataFrame:
    """Where a keyed bijection of 0..n-1 sends ``idx``: nothing is sorted and no other row is looked at.

    The numbers 0..ab-1, with a = ceil(sqrt n) and b = ceil(n / a), are pairs (l, r) of Z_a and Z_b. In each round one half
    is moved by a keyed number of the other (a Feistel network), which is a bijection. A number from n on is sent on until it
    falls below n: there are less than a of them, so after that many rounds it has.
    """
    def whole(y: Column, by: Column) -> Column:
        return ((y - y % by) / by).cast("bigint")

    m, one = F.lit(MIX_MODULUS).cast("bigint"), F.lit(1).cast("bigint")
    a, b = F.col("_a"), F.col("_b")

    def keyed(other: Column, i: Column | int) -> Column:
        return (other * MIX_MULTIPLIER + F.col(key) + i * ROUND_STRIDE) % m

    def moved(half: Column, y: Column, size: Column) -> Column:
        return (half + ((y * y) % m + y) % m) % size

    def sent_on(x: Column) -> Column:
        start = F.struct(whole(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(
            F.sequence(one, F.lit(ROUNDS).cast("bigint")), start,
            lambda s, i: F.struct(F.when(i % 2 == 1, moved(s["l"], keyed(s["r"], i), a)).otherwise(s["l"]).alias("l"),
                                  F.when(i % 2 == 0, moved(s["r"], keyed(s["l"], i), b)).otherwise(s["r"]).alias("r")),
            lambda s: s["l"] * b + s["r"])

    rows = df.withColumn("_a", F.ceil(F.sqrt(n)).cast("bigint")).withColumn("_b", whole(F.col(n) + a - 1, a))
    rows = rows.withColumns({"_l": whole(F.col(idx), b), "_r": F.col(idx) % b})
    for i in range(1, ROUNDS + 1):  # compiled, unlike the few rows' further passes below
        half, other, size = ("_l", "_r", a) if i % 2 else ("_r", "_l", b)
        rows = rows.withColumn("_y", keyed(F.col(other), i)).withColumn(half, moved(F.col(half), F.col("_y"), size))
    first = F.col("_first")
    # never NULL (and so never -1): else a join on it would copy the whole expression into a filter
    walked = F.when(first < F.col(n), first).otherwise(F.aggregate(F.sequence(one, a), first, lambda x, i: F.when(x < F.col(n), x).otherwise(sent_on(x))))
    return rows.withColumn("_first", F.col("_l") * b + F.col("_r")).withColumn(out, F.coalesce(walked, F.lit(-1))).drop("_a", "_b", "_l", "_r", "_y", "_first")


def keyed_place_sql(x: str, n: str, key: str) -> str:
    """One pass of :func:`with_keyed_place` over the pairs; a result of ``n`` or more has to be sent on."""
    m = MIX_MODULUS
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    b = f"(({n} + {a} - 1) // {a})"

    def moved(half: int, other: int, size: str) -> str:
        y = f"((s[{other}] * {MIX_MULTIPLIER} + {key} + t[1] * {ROUND_STRIDE}) % {m})"
        return f"((s[{half}] + (({y} * {y}) % {m} + {y}) % {m}) % {size})"

    rounds = ", ".join(f"[CAST({i} AS BIGINT), 0]" for i in range(1, ROUNDS + 1))
    pair = (f"list_reduce([[CAST({x} AS BIGINT) // {b}, CAST({x} AS BIGINT) % {b}], {rounds}], lambda s, t: "
            f"CASE WHEN t[1] % 2 = 1 THEN [{moved(1, 2, a)}, s[2]] ELSE [s[1], {moved(2, 1, b)}] END)")
    return f"list_reduce({pair}, lambda l, r: l * {b} + r)"


def permutation_heterogeneity(groups: DataFrame, family: Sequence[str], key: str, cell: str, arm: str, x: str,
                              draws: int, seed: int) -> DataFrame:
    """Between-cell spread of ``x`` against its permutations within ``arm``, per ``family``.

    The statistic is the group-count weighted sum of squared deviations of cell means. In every draw the value of a group
    moves to the place that a bijection keyed by the draw gives it (:func:`with_keyed_place`), so no task orders an arm: a row
    is expanded to its draws where it lies, meets the cell of its place, and partial sums of cells are what is shuffled.
    """
    family = list(family)
    base = cut_lineage(groups.select(*family, key, cell, arm, x))
    n_rows = base.count()
    sizes = base.groupBy(*family, arm).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut_lineage(dense_index(base, [*family, arm], key).join(sizes, [*family, arm]))
    spread_out = placed.repartition(*family, arm, "idx").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "_key", round_key(seed, F.col("draw")))
    gone = with_keyed_place(spread_out, "idx", "_n", "_key", "_place").select(*family, arm, "draw", "_place", x)
    cells_at = placed.select(*family, arm, F.col("idx").alias("_place"), cell)
    moved = gone.join(_small(cells_at, n_rows), [*family, arm, "_place"])
    overall = base.groupBy(*family).agg(F.avg(x).alias("_all"))

    def spread(rows: DataFrame, extra: list[str]) -> DataFrame:
        cells = rows.groupBy(*family, *extra, cell).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_m"))
        return (cells.join(overall, family).groupBy(*family, *extra)
                .agg(F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_all"), 2)).alias("statistic")))

    observed = spread(base, [])
    drawn = spread(moved, ["draw"]).withColumnRenamed("statistic", "_drawn")
    # round-off slack: an equal arrangement summed in another order counts as reached
    reached = F.col("_drawn") >= F.col("statistic") - 1e-9
    return (
        drawn.join(observed, family).groupBy(*family)
        .agg(F.max("statistic").alias("statistic"), F.count_if(reached).alias("exceedances"))
        .withColumn("p", (F.col("exceedances") + 1) / F.lit(draws + 1))
    )
