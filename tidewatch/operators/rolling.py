"""Rolling variance-family statistics over per-cycle series.

Input is a dense series: one row per key and cycle. Every frame is a fixed number of rows around the current one,
so a series of any length can also be cut into blocks that carry the rows of their neighbours
(:func:`with_blocks`) and be worked on by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.inference import cumulative_below
from tidewatch.session import cut_lineage

# Cycles of a series whose kernel means are found together.
KERNEL_BLOCK = 1024
# Series of one axis worked on together; their arrays stay in a core's cache.
STACK = 64


def by_axis(rows: pd.DataFrame, names: Sequence[str], work: Callable[..., dict[str, np.ndarray]]) -> pd.DataFrame:
    """``work(cycle, *values)`` on the series of a batch that share their cycles, up to ``STACK`` of them at once.

    ``rows`` has a row for each series: its cycles and then the columns of values, all as arrays. Values and results are
    matrices of series and cycles with NaN for NULL; ``names`` are the results wanted.
    """
    axes: dict[bytes, list[int]] = {}
    for i, c in enumerate(rows["cycle"]):
        axes.setdefault(np.asarray(c, np.int64).tobytes(), []).append(i)
    values = [rows[c].to_numpy() for c in rows.columns if c != "cycle"]
    out = {name: np.empty(len(rows), dtype=object) for name in names}
    for axis, members in axes.items():
        cycle = np.frombuffer(axis, np.int64)
        for lo in range(0, len(members), STACK):
            part = members[lo:lo + STACK]
            found = work(cycle, *[np.stack([np.asarray(v[i], np.float64) for i in part]) for v in values])
            for name in names:
                for i, row in zip(part, found[name]):
                    out[name][i] = row
    return pd.DataFrame(out)


def filled(cycle: np.ndarray, x: np.ndarray, max_gap: int) -> np.ndarray:
    """:func:`fill_gaps` on a matrix of series and cycles."""
    if max_gap == 0 or not len(cycle):
        return x
    known, place = ~np.isnan(x), np.arange(len(cycle))
    before = np.maximum.accumulate(np.where(known, place, -1), axis=1)
    after = np.minimum.accumulate(np.where(known, place, len(cycle))[:, ::-1], axis=1)[:, ::-1]
    row, at = np.nonzero(~known & (before >= 0) & (after < len(cycle)))
    b, a = before[row, at], after[row, at]
    near = cycle[a] - cycle[b] - 1 <= max_gap
    row, at, a, b = row[near], at[near], a[near], b[near]
    out = x.copy()
    slope = (x[row, a] - x[row, b]) / (cycle[a] - cycle[b])
    out[row, at] = x[row, b] + slope * (cycle[at] - cycle[b])
    return out


def window_legs(cycle: np.ndarray, value: np.ndarray, window: int, min_frac: float, detrend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Variance and lag-1 autocorrelation of the window ending at each cycle, NaN where undefined; see :func:`rolling_var_ac`.

    Each window is centred on its own mean before anything is squared; sums run over the places of all windows at once.
    """
    need, m = max(4, math.ceil(min_frac * window)), value.shape[1] - window + 1
    var, ac = np.full(value.shape, np.nan), np.full(value.shape, np.nan)
    if m < 1 or not len(value):
        return var, ac
    ok = ~np.isnan(value)
    b, known = np.where(ok, value, 0.0), ok.astype(np.float64)
    both = known[:, 1:] * known[:, :-1]
    t = cycle.astype(np.float64)
    over = lambda x, n: sum(x[:, j:j + m] for j in range(n))
    k, n = over(known, window), over(both, window - 1)
    safe_k, safe_n = np.maximum(k, 1), np.maximum(n, 1)
    mean = over(b, window) / safe_k
    mean_a, mean_b = over(b[:, :-1] * both, window - 1) / safe_n, over(b[:, 1:] * both, window - 1) / safe_n
    if detrend:
        mean_t, mean_u = over(t * known, window) / safe_k, over(t[1:] * both, window - 1) / safe_n
    syy, sxy, sxx, va, vb, cov, at, bt, tt = np.zeros((9, *k.shape))
    for j in range(window):
        y = (b[:, j:j + m] - mean) * known[:, j:j + m]
        syy += y * y
        if detrend:
            x = (t[j:j + m] - mean_t) * known[:, j:j + m]
            sxy += x * y
            sxx += x * x
    for j in range(window - 1):
        pair = both[:, j:j + m]
        pa, pb = (b[:, j:j + m] - mean_a) * pair, (b[:, j + 1:j + 1 + m] - mean_b) * pair
        va += pa * pa
        vb += pb * pb
        cov += pa * pb
        if detrend:
            pt = (t[j + 1:j + 1 + m] - mean_u) * pair
            at += pa * pt
            bt += pb * pt
            tt += pt * pt
    if detrend:
        beta = np.divide(sxy, sxx, out=np.full(k.shape, np.nan), where=sxx != 0)
        syy = syy - beta * sxy
        va, vb, cov = (va - 2 * beta * at + beta * beta * tt, vb - 2 * beta * bt + beta * beta * tt, cov - beta * at - beta * bt + beta * beta * tt)
    va, vb, cov, valid = va / safe_n, vb / safe_n, cov / safe_n, k >= need
    # a leg counts as constant below a standard deviation of 1e-12
    usable = valid & (n >= 4) & (va >= 1e-24) & (vb >= 1e-24)
    np.divide(np.maximum(syy, 0.0), k - 1, out=var[:, window - 1:], where=valid)
    np.divide(cov, np.sqrt(np.where(usable, va * vb, 1.0)), out=ac[:, window - 1:], where=usable)
    return var, ac


def standard_rows(cycle: np.ndarray, x: np.ndarray, window: int, baseline_end: int, min_n: int = 8) -> np.ndarray:
    """:func:`baseline_z` of one leg on a matrix of series and cycles."""
    ref = x[:, (cycle >= window - 1) & (cycle < baseline_end)]
    known = ~np.isnan(ref)
    n = known.sum(axis=1, keepdims=True)
    mean = np.where(known, ref, 0.0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
    d = np.where(known, ref - mean, 0.0)
    sd = np.sqrt((d * d).sum(axis=1, keepdims=True) / np.maximum(n - 1, 1))
    return np.where(n >= min_n, (x - mean) / np.where(sd > 1e-9, sd, 1e-9), np.nan)


def mean_known(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Mean of matrices place by place, skipping NaN; NaN where all are."""
    n = sum((~np.isnan(p)).astype(np.float64) for p in parts)
    return np.divide(sum(np.where(np.isnan(p), 0.0, p) for p in parts), n, out=np.full(parts[0].shape, np.nan), where=n > 0)


def series_arrays(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row for each key with ``_rows``, its cycles and ``cols`` in order of cycle."""
    by_cycle = F.sort_array(F.collect_list(F.struct(F.col("cycle").alias("_at"), *cols)))
    return df.groupBy(*keys).agg(by_cycle.alias("_rows"))


def array_columns(values: dict[str, str]) -> Column:
    """The struct that :func:`by_axis` takes: cycles and, under each name, the values of a column of ``_rows``."""
    return F.struct(F.col("_rows._at").alias("cycle"), *[F.col(f"_rows.{c}").cast("array<double>").alias(n) for n, c in values.items()])


def array_type(names: Sequence[str]) -> str:
    return f"struct<{', '.join(f'{n}: array<double>' for n in names)}>"


def known_value(c: str) -> Column:
    """NaN from a worker's arrays back to NULL."""
    return F.nanvl(c, F.lit(None).cast("double"))


def unpivot_classes(series: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Wide measures to rows ``(keys, cycle, class, x)``."""
    return series.unpivot([*keys, "cycle"], list(classes), "class", "x")


def fill_gaps(df: DataFrame, keys: Sequence[str], x: str = "x", max_gap: int = 3, out: str = "y") -> DataFrame:
    """Interpolate interior gaps of at most ``max_gap`` cycles linearly; longer and edge gaps stay NULL.

    Known neighbours further than ``max_gap`` away cannot matter, hence the bounded frames.
    """
    if max_gap == 0:
        return df.withColumn(out, F.col(x))
    order = W.partitionBy(*keys).orderBy("cycle")
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("cycle").alias("c"), F.col(x).alias("v")))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(-max_gap, -1))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(1, max_gap))
    gap = F.col("_a.c") - F.col("_b.c") - 1
    slope = (F.col("_a.v") - F.col("_b.v")) / (F.col("_a.c") - F.col("_b.c"))
    value = F.coalesce(
        F.col(x), F.when(gap <= max_gap, F.col("_b.v") + slope * (F.col("cycle") - F.col("_b.c"))))
    return df.withColumns({"_b": before, "_a": after}).withColumn(out, value).drop("_b", "_a")


def rolling_var_ac(
    df: DataFrame, keys: Sequence[str], y: str = "y", window: int = 30, min_frac: float = 0.5,
    detrend: bool = True,
) -> DataFrame:
    """Add ``var`` and ``ac``: variance and lag-1 autocorrelation of the window ending at each row.

    With ``detrend`` the window's own least-squares line is removed first; without, only its mean. The autocorrelation uses the
    consecutive valid pairs inside the window. The rows of a key are one array; :func:`with_blocks` cuts keys that are too long
    for that.
    """
    @F.pandas_udf(array_type(["var", "ac"]))
    def windows(rows: pd.DataFrame) -> pd.DataFrame:
        return by_axis(rows, ["var", "ac"], lambda c, v: dict(zip(["var", "ac"], window_legs(c, v, window, min_frac, detrend))))

    rest = [c for c in df.columns if c not in keys]
    done = series_arrays(df, keys, rest).withColumn("_legs", windows(array_columns({"value": y})))
    each = done.select(*keys, F.explode(F.arrays_zip("_rows", F.col("_legs.var").alias("var"), F.col("_legs.ac").alias("ac"))).alias("_r"))
    legs = [known_value(f"_r.{c}").alias(c) for c in ("var", "ac")]
    return each.select(*keys, *[F.col(f"_r._rows.{c}").alias(c) for c in rest], *legs).select(*df.columns, "var", "ac")


def with_blocks(df: DataFrame, keys: Sequence[str], block: int, before: int, after: int) -> DataFrame:
    """Cut long series into blocks of ``block`` cycles, each with copies of its neighbours' rows.

    Adds ``_block`` and ``_own``; window over ``(*keys, _block)``, then keep the ``_own`` rows. ``before`` and
    ``after`` are the rows a frame may reach to each side, so the result equals the uncut one.
    """
    c = F.col("cycle")
    reach = F.sequence(F.floor((c - after) / block), F.floor((c + before) / block))
    return (
        df.withColumn("_block", F.explode(reach))
        .where(F.col("_block") >= 0)
        .withColumn("_own", F.floor(c / block) == F.col("_block"))
    )


def rolling_statistics(
    series: DataFrame, keys: Sequence[str], classes: Sequence[str], window: int = 30, min_frac: float = 0.5,
    max_gap: int = 3, detrend: bool = True, block: int | None = None,
) -> DataFrame:
    """Gap filling and rolling statistics of every class: rows ``(keys, class, cycle, y, var, ac)``.

    Without ``block`` all classes of a key are worked on in the arrays of its one row.
    """
    if block is None:
        names = [f"{leg}{i}" for i in range(len(classes)) for leg in ("y", "var", "ac")]

        @F.pandas_udf(array_type(names))
        def legs(rows: pd.DataFrame) -> pd.DataFrame:
            def work(cycle, *xs):
                out = {}
                for i, x in enumerate(xs):
                    out[f"y{i}"] = filled(cycle, x, max_gap)
                    out[f"var{i}"], out[f"ac{i}"] = window_legs(cycle, out[f"y{i}"], window, min_frac, detrend)
                return out
            return by_axis(rows, names, work)

        done = series_arrays(series, keys, classes).withColumn("_legs", legs(array_columns({f"x{i}": c for i, c in enumerate(classes)})))
        per_class = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.arrays_zip(
            F.col("_rows._at").alias("cycle"), *[F.col(f"_legs.{leg}{i}").alias(leg) for leg in ("y", "var", "ac")]).alias("z")) for i, c in enumerate(classes)]))
        each = done.select(*keys, per_class.alias("_c")).select(*keys, F.col("_c.class").alias("class"), F.explode("_c.z").alias("_r"))
        return each.select(*keys, "class", F.col("_r.cycle").alias("cycle"), *[known_value(f"_r.{leg}").alias(leg) for leg in ("y", "var", "ac")])
    part = [*keys, "class", "_block"]
    long = with_blocks(unpivot_classes(series, keys, classes), [*keys, "class"], block, before=window + max_gap, after=max_gap)
    out = rolling_var_ac(fill_gaps(long, part, max_gap=max_gap), part, window=window, min_frac=min_frac, detrend=detrend)
    out = out.where("_own").withColumns({leg: F.when(F.col("cycle") >= window - 1, F.col(leg)) for leg in ("var", "ac")})
    return out.select(*keys, "class", "cycle", "y", "var", "ac")


def mixed_legs(cycle: np.ndarray, ys: Sequence[np.ndarray], window: int, min_frac: float, baseline_end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The standardised legs of every class from its gap-filled values."""
    legs = [window_legs(cycle, y, window, min_frac, True) for y in ys]
    return [tuple(standard_rows(cycle, leg, window, baseline_end) for leg in pair) for pair in legs]


def class_scores(series: DataFrame, keys: Sequence[str], classes: Sequence[str], window: int, min_frac: float, max_gap: int,
                 baseline_end: int, carry: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys, cycle, z_var, z_ac, carry…)``: gap filling, rolling statistics, :func:`baseline_z` and :func:`mix_classes` in
    the arrays of a key's one row. ``carry`` names columns of ``series`` that are kept."""
    @F.pandas_udf(array_type(["z_var", "z_ac"]))
    def scores(rows: pd.DataFrame) -> pd.DataFrame:
        def work(cycle, *xs):
            legs = mixed_legs(cycle, [filled(cycle, x, max_gap) for x in xs], window, min_frac, baseline_end)
            return {"z_var": mean_known([v for v, _ in legs]), "z_ac": mean_known([a for _, a in legs])}
        return by_axis(rows, ["z_var", "z_ac"], work)

    done = series_arrays(series, keys, list(dict.fromkeys([*classes, *carry]))).withColumn("_z", scores(array_columns({f"x{i}": c for i, c in enumerate(classes)})))
    each = done.select(*keys, F.explode(F.arrays_zip(
        F.col("_rows._at").alias("cycle"), F.col("_z.z_var").alias("z_var"), F.col("_z.z_ac").alias("z_ac"), *[F.col(f"_rows.{c}").alias(c) for c in carry])).alias("_r"))
    return each.select(*keys, F.col("_r.cycle").alias("cycle"), known_value("_r.z_var").alias("z_var"), known_value("_r.z_ac").alias("z_ac"),
                       *[F.col(f"_r.{c}").alias(c) for c in carry])


def standardised(col: Column, mean: Column, sd: Column, n: Column, min_n: int = 8) -> Column:
    """Distance from a reference mean in reference standard deviations; NULL on a short reference."""
    return F.when(n >= min_n, (col - mean) / F.when(sd > 1e-9, sd).otherwise(F.lit(1e-9)))


def baseline_z(stats: DataFrame, keys: Sequence[str], window: int, baseline_end: int) -> DataFrame:
    """Add ``z_var`` and ``z_ac`` per class against that class's own cycles ``[window-1, baseline_end)``.

    The reference is a conditional aggregate over the partitioning the rolling statistics already have.
    """
    whole = W.partitionBy(*keys, "class")
    inside = (F.col("cycle") >= window - 1) & (F.col("cycle") < baseline_end)
    refs = {}
    for leg in ("var", "ac"):
        x = F.when(inside, F.col(leg))
        refs |= {f"_m_{leg}": F.avg(x).over(whole), f"_s_{leg}": F.stddev_samp(x).over(whole),
                 f"_n_{leg}": F.count(x).over(whole)}
    out = stats.withColumns(refs)
    return out.withColumns({
        f"z_{leg}": standardised(F.col(leg), F.col(f"_m_{leg}"), F.col(f"_s_{leg}"), F.col(f"_n_{leg}"))
        for leg in ("var", "ac")
    }).drop(*refs)


def mix_classes(z: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of each leg over classes, skipping undefined ones: rows ``(keys, cycle, z_var, z_ac)``."""
    return z.groupBy(*keys, "cycle").agg(F.avg("z_var").alias("z_var"), F.avg("z_ac").alias("z_ac"))


def twin_baseline_z(
    stats: DataFrame, twin: DataFrame, keys: Sequence[str], window: int, baseline_end: int,
) -> DataFrame:
    """As :func:`baseline_z`, but the reference comes from the matched series in ``twin``."""
    inside = (F.col("cycle") >= window - 1) & (F.col("cycle") < baseline_end)
    legs = ("var", "ac")
    ref = twin.where(inside).groupBy(*keys, "class").agg(
        *[f(leg).alias(f"_{p}_{leg}") for leg in legs
          for p, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    out = stats.join(ref, [*keys, "class"], "left")
    return out.withColumns({
        f"z_{leg}": standardised(F.col(leg), F.col(f"_m_{leg}"), F.col(f"_s_{leg}"),
                                 F.coalesce(F.col(f"_n_{leg}"), F.lit(0)))
        for leg in legs
    }).select(*stats.columns, "z_var", "z_ac")


def kernel_mean(cycle: np.ndarray, value: np.ndarray, bandwidth: float, reach: int) -> np.ndarray:
    """Gaussian-kernel mean at each known value over the known ones within ``reach`` cycles; NaN elsewhere."""
    place = cycle - cycle.min()
    wy, w = np.zeros((2, len(value), place.max() + 1))
    found = ~np.isnan(value)
    wy[:, place], w[:, place] = np.where(found, value, 0.0), found
    total, weight = wy.copy(), w.copy()
    for d in range(1, min(reach, wy.shape[1] - 1) + 1):
        g = math.exp(-0.5 * (d / bandwidth) ** 2)
        for into, x in ((total, wy), (weight, w)):
            into[:, d:] += g * x[:, :-d]
            into[:, :-d] += g * x[:, d:]
    return np.divide(total[:, place], weight[:, place], out=np.full(value.shape, np.nan), where=found)


def kernel_statistics(series: DataFrame, keys: Sequence[str], classes: Sequence[str], window: int, min_frac: float = 0.5,
                      max_gap: int = 3, bandwidth: float = 10.0) -> DataFrame:
    """Rows ``(keys, class, cycle, var, ac)``: gap filling, :func:`kernel_residual` and the rolling statistics of the residual, which is
    centred but not detrended again, in the arrays of a key's one row."""
    names, reach = [f"{leg}{i}" for i in range(len(classes)) for leg in ("var", "ac")], ceil(8.5 * bandwidth)

    @F.pandas_udf(array_type(names))
    def legs(rows: pd.DataFrame) -> pd.DataFrame:
        def work(cycle, *xs):
            out = {}
            for i, x in enumerate(xs):
                y = filled(cycle, x, max_gap)
                enough = (~np.isnan(y)).sum(axis=1, keepdims=True) >= 5
                r = np.where(enough, y - kernel_mean(cycle, y, bandwidth, reach), np.nan)
                out[f"var{i}"], out[f"ac{i}"] = window_legs(cycle, r, window, min_frac, False)
            return out
        return by_axis(rows, names, work)

    done = series_arrays(series, keys, classes).withColumn("_legs", legs(array_columns({f"x{i}": c for i, c in enumerate(classes)})))
    per_class = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.arrays_zip(
        F.col("_rows._at").alias("cycle"), F.col(f"_legs.var{i}").alias("var"), F.col(f"_legs.ac{i}").alias("ac")).alias("z")) for i, c in enumerate(classes)]))
    each = done.select(*keys, per_class.alias("_c")).select(*keys, F.col("_c.class").alias("class"), F.explode("_c.z").alias("_r"))
    return each.select(*keys, "class", F.col("_r.cycle").alias("cycle"), known_value("_r.var").alias("var"), known_value("_r.ac").alias("ac"))


def kernel_residual(df: DataFrame, keys: Sequence[str], y: str = "y", bandwidth: float = 10.0, reach: int | None = None,
                    out: str = "r") -> DataFrame:
    """Residual of each known value from a Gaussian-kernel mean over the cycles within ``reach``.

    Unless given, ``reach`` is eight and a half bandwidths: weights beyond are below 2.1e-16 of the centre, the rounding of a
    double. A series is cut into blocks of ``KERNEL_BLOCK`` cycles that carry the rows within ``reach`` of them; the rows of a
    block are one array, and a batch of blocks is worked on at once. A series with fewer than five known values gives NULL.
    """
    reach = ceil(8.5 * bandwidth) if reach is None else reach

    @F.pandas_udf("array<double>")
    def means(blocks: pd.DataFrame) -> pd.Series:
        return by_axis(blocks, ["mean"], lambda c, v: {"mean": kernel_mean(c, v, bandwidth, reach)})["mean"]

    rest = [c for c in df.columns if c not in keys]
    whole, c = W.partitionBy(*keys), F.col("cycle")
    block = lambda x: F.floor(x / KERNEL_BLOCK)
    first, last = block(F.min(c).over(whole)), block(F.max(c).over(whole))  # a series' own blocks
    near = df.withColumns({"_known": F.count(y).over(whole) >= 5, "_first": F.greatest(first, block(c - reach)), "_last": F.least(last, block(c + reach))})
    cut = near.withColumn("_block", F.explode(F.sequence("_first", "_last"))).withColumn("_own", block(c) == F.col("_block"))
    blocks = series_arrays(cut, [*keys, "_block"], [*rest, "_known", "_own"]).withColumn("_mean", means(array_columns({"value": y})))
    each = blocks.select(*keys, F.explode(F.arrays_zip("_rows", "_mean")).alias("_r")).where("_r._rows._own")
    mean = F.when(F.col("_r._rows._known"), known_value("_r._mean"))
    return each.select(*keys, *[F.col(f"_r._rows.{c}").alias(c) for c in rest], (F.col(f"_r._rows.{y}") - mean).alias(out)).select(*df.columns, out)


def trailing_mean(df: DataFrame, keys: Sequence[str], x: str, window: int, out: str) -> DataFrame:
    """Mean of the known values among the last ``window`` rows, given at least max(3, window // 3) of them."""
    frame = W.partitionBy(*keys).orderBy("cycle").rowsBetween(1 - window, 0)
    enough = F.count(x).over(frame) >= max(3, window // 3)
    return df.withColumn(out, F.when(enough, F.avg(x).over(frame)))


def pooled_trailing_mean(df: DataFrame, keys: Sequence[str], total: str, count: str, window: int,
                         out: str) -> DataFrame:
    """Mean of all events of the last ``window`` cycles: sums over counts, not a mean of cycle means."""
    frame = W.partitionBy(*keys).orderBy("cycle").rowsBetween(1 - window, 0)
    n = F.sum(F.coalesce(F.col(count), F.lit(0))).over(frame)
    return df.withColumns({out: F.try_divide(F.sum(total).over(frame), n), f"{out}_n": n})


def pair_signs(points: Column, cell: str, same: bool) -> Column:
    """Sum of the signs of ``v`` over pairs of one array, earlier point first; pairs within one ``cell`` only, or across cells only."""
    def sign(p, q):
        apart = p[cell] == q[cell] if same else p[cell] != q[cell]
        return F.when((p["t"] < q["t"]) & apart, F.signum(q["v"] - p["v"])).otherwise(F.lit(0)).cast("bigint")

    zero = F.lit(0).cast("bigint")
    return F.aggregate(points, zero, lambda acc, p: acc + F.aggregate(points, zero, lambda part, q: part + sign(p, q)))


def kendall_tau(df: DataFrame, keys: Sequence[str], x: str, out: str = "tau", time: str = "cycle", block: int = 64) -> DataFrame:
    """Tau-b of every whole series against time: rows ``(keys…, n, tau)``; NULL below four known values or with all of them tied.

    No task sees a whole series. Time is cut into blocks of ``block`` cycles and the distinct values of a series into buckets of
    ``block`` by rank. A pair of points lies in one time block, or in one bucket, or differs in both:

    * pairs of a time block from different buckets are counted in the block, which has ``block`` points at most;
    * pairs of a bucket are counted there over its distinct values in each time block and, across blocks, on the points of the
      bucket; a bucket is cut by value, so equal values, which add nothing, do not fill it: they are carried as counts;
    * all others are told by their block and bucket alone: for a cell of the (block, bucket) grid it takes the points of earlier
      blocks in lower buckets less those in higher ones, a running count along time and then along the buckets.

    ``time`` is a whole number, distinct within a series.
    """
    keys = list(keys)
    known = df.where(F.col(x).isNotNull()).select(*keys, F.col(time).alias("t"), F.col(x).alias("v"))
    values = known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = cumulative_below(values.withColumn("_one", F.lit(1)), keys, "v", ["_one"], 64)
    buckets = ranked.select(*keys, "v", F.floor(F.col("below__one") / block).alias("bucket"))
    points = cut_lineage(known.join(buckets, [*keys, "v"]).withColumn("slab", F.floor(F.col("t") / block)))

    inside = points.groupBy(*keys, "slab").agg(pair_signs(F.collect_list(F.struct("t", "v", "bucket")), "bucket", same=False).alias("s"))
    # one bucket: a row for each value and slab; within a slab by time, across slabs by counts
    near = points.groupBy(*keys, "bucket", "slab").agg(pair_signs(F.collect_list(F.struct("t", "v", "bucket")), "bucket", same=True).alias("s"))
    per = points.groupBy(*keys, "bucket", "slab", "v").agg(F.count(F.lit(1)).alias("c"))
    levels = points.select(*keys, "bucket", F.col("v").alias("u")).distinct()
    slabs = points.select(*keys, "bucket", "slab").distinct()
    # for every value of the bucket the points of earlier slabs at it, at each slab of the bucket
    earlier = W.partitionBy(*keys, "bucket", "u").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    table = slabs.join(levels, [*keys, "bucket"]).join(per.withColumnRenamed("v", "u"), [*keys, "bucket", "slab", "u"], "left")
    table = table.select(*keys, "bucket", "slab", "u", F.coalesce("c", F.lit(0)).alias("c")).withColumn("_before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    row = W.partitionBy(*keys, "bucket", "slab").orderBy("u")
    lower = F.coalesce(F.sum("_before").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    higher = F.coalesce(F.sum("_before").over(row.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    across = table.withColumn("s", F.col("c") * (lower - higher)).select(*keys, "s")
    # the grid of slabs and buckets
    cells = points.groupBy(*keys, "slab", "bucket").agg(F.count(F.lit(1)).alias("c"))
    grid = points.select(*keys, "slab").distinct().join(points.select(*keys, "bucket").distinct(), keys).join(cells, [*keys, "slab", "bucket"], "left")
    along = W.partitionBy(*keys, "bucket").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("_before", F.coalesce(F.sum("c").over(along), F.lit(0)))
    line = W.partitionBy(*keys, "slab").orderBy("bucket")
    below = F.coalesce(F.sum("_before").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("_before").over(line.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    far = grid.withColumn("s", F.col("c") * (below - above)).select(*keys, "s")

    total = inside.select(*keys, "s").unionByName(near.select(*keys, "s")).unionByName(across).unionByName(far).groupBy(*keys).agg(F.sum("s").alias("_s"))
    ties = values.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("_tied"))
    every = df.select(*keys).distinct().join(ties, keys, "left").join(total, keys, "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return every.select(*keys, n.alias("n"), tau_b(n, F.col("_s"), F.col("_tied")).alias(out))


def tau_b(n: Column, s: Column, tied: Column) -> Column:
    """Tau-b from the number of points, the sum of pair signs and the pairs tied in value only."""
    pairs = n * (n - 1) / 2
    return F.when(n >= 4, F.try_divide(s.cast("double"), F.sqrt((pairs - tied) * pairs)))


def rolling_tau(df: DataFrame, keys: Sequence[str], x: str | Sequence[str], span: int, out: str | Sequence[str]) -> DataFrame:
    """Kendall tau-b against time of the last ``span`` values, given max(4, floor(0.6 span)) known ones.

    The rows of a key are one array. The pairs of two values ``d`` rows apart have their signs taken once, and running totals of
    them tell the sum in every window; these are integers, so the work per row is linear in ``span`` and the result exact.
    ``x`` and ``out`` may be several columns, which share one array of rows.
    """
    names, outs = ([x], [out]) if isinstance(x, str) else (list(x), list(out))
    need = max(4, int(0.6 * span))

    def one(y: np.ndarray) -> np.ndarray:
        tau = np.full(len(y), np.nan)
        if len(y) < span:
            return tau
        ends = np.arange(span - 1, len(y))

        def within(terms: np.ndarray, d: int) -> np.ndarray:
            """Sum over the pairs (i, i + d) of each window."""
            so_far = np.concatenate([[0], np.cumsum(terms, dtype=np.int64)])
            return so_far[ends - d + 1] - so_far[ends - span + 1]

        n = within(~np.isnan(y), 0)
        s, tied = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for d in range(1, span):
            early, late = y[:-d], y[d:]  # comparisons with a missing value are false
            more, less = early < late, early > late
            s += within(more.astype(np.int8) - less, d)
            tied += within(early == late, d)
        pairs = n * (n - 1) / 2
        spread = np.sqrt((pairs - tied) * pairs)
        tau[ends] = np.divide(s, spread, out=np.full(len(ends), np.nan), where=(n >= need) & (spread > 0))
        return tau

    @F.pandas_udf(f"struct<{', '.join(f't{i}: array<double>' for i in range(len(names)))}>")
    def windows(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({f"t{i}": pd.Series([one(np.asarray(v, np.float64)) for v in rows[f"x{i}"]], dtype=object) for i in range(len(names))})

    rest = [c for c in df.columns if c not in keys]
    by_cycle = F.array_sort(F.collect_list(F.struct(F.col("cycle").alias("_at"), *rest)))
    values = [F.col(f"_rows.{c}").cast("array<double>").alias(f"x{i}") for i, c in enumerate(names)]
    done = df.groupBy(*keys).agg(by_cycle.alias("_rows")).withColumn("_taus", windows(F.struct(*values)))
    each = done.select(*keys, F.explode(F.arrays_zip("_rows", *[F.col(f"_taus.t{i}").alias(f"t{i}") for i in range(len(names))])).alias("_r"))
    taus = [F.nanvl(f"_r.t{i}", F.lit(None).cast("double")).alias(o) for i, o in enumerate(outs)]
    return each.select(*keys, *[F.col(f"_r._rows.{c}").alias(c) for c in rest], *taus).select(*df.columns, *outs)
