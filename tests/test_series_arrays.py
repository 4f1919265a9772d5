"""The steps on whole series as arrays against the same steps on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alarms, calibrate, inference, recovery, rolling
from tidewatch.operators.alarms import LaggingRule, LeadingRule

KEYS = ["run"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    rows = []
    for run in range(8):
        x = rng.normal(10, 2, (100, 2)) + (np.arange(100)[:, None] > 70) * run
        x[rng.random((100, 2)) < 0.15] = np.nan
        x[20:26, 0] = np.nan
        if run == 5:
            x[:, 0] = np.nan
        if run == 6:
            x[:, 1] = 3.0
        rows += [(run, c, *[None if np.isnan(v) else float(v) for v in x[c]]) for c in range(100) if run != 7 or c % 9]
    return spark.createDataFrame(rows, "run INT, cycle INT, form DOUBLE, esc DOUBLE").cache()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(one, two, keys, cols):
    a, b = ({tuple(r[k] for k in keys): [r[c] for c in cols] for r in df.collect()} for df in (one, two))
    assert a.keys() == b.keys() and a
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-7)), (k, a[k], b[k])


def test_scores_take_no_window_over_rows(series):
    rule = LeadingRule(window=12, start=50)
    got = alarms.score_series(series, KEYS, rule, carry=("esc",))
    long = rolling.unpivot_classes(series, KEYS, rule.classes)
    stats = rolling.rolling_var_ac(rolling.fill_gaps(long, ["run", "class"]), ["run", "class"], window=12)
    want = rolling.mix_classes(rolling.baseline_z(stats, KEYS, 12, 50), KEYS)
    same(got, want, ["run", "cycle"], ["z_var", "z_ac"])
    same(got, series, ["run", "cycle"], ["esc"])
    assert "Window" not in plan(got) and "Join" not in plan(got)


def test_kernel_statistics_take_one_array_for_a_series(series):
    got = rolling.kernel_statistics(series, KEYS, ("form", "esc"), 12)
    filled = rolling.fill_gaps(rolling.unpivot_classes(series, KEYS, ("form", "esc")), ["run", "class"])
    want = rolling.rolling_var_ac(rolling.kernel_residual(filled, ["run", "class"]), ["run", "class"], y="r", window=12, detrend=False)
    same(got, want, ["run", "class", "cycle"], ["var", "ac"])
    assert "Window" not in plan(got) and plan(got).count("ArrowEvalPython") == 1


def test_driver_is_compared_without_joins(series):
    joined = series.withColumns({"score": F.col("form"), "a": F.col("esc") / 10})
    got = recovery.indicator_vs_latent(joined, KEYS, "score", "a", 10, 100, 0.45, smooth=8, min_length=30, min_points=10)
    legs = recovery.indicator_legs(joined, KEYS, {"m": "score", "v": "esc"}, "a", 10, 100, 0.45, smooth=8, min_length=30, min_points=10)
    crossed = joined.groupBy("run").agg(F.greatest(F.lit(40), F.coalesce(F.min(F.when(F.col("a") <= 0.45, F.col("cycle"))), F.lit(100))).alias("stop"))
    seg = joined.join(crossed, "run").where((F.col("cycle") >= 10) & (F.col("cycle") < F.col("stop")))

    def rho(c):
        pts = rolling.trailing_mean(seg, KEYS, c, 8, "_s").select("run", F.round("_s", 9).alias("p"), F.round("a", 9).alias("q"))
        return crossed.join(inference.spearman(pts, KEYS, "p", "q"), "run", "left").withColumn("rho", F.when(F.col("n") >= 10, F.col("rho")))

    same(got, rho("score"), ["run"], ["stop", "n", "rho"])
    plain = seg.groupBy("run").agg(F.count_if(F.col("score").isNotNull() & F.col("a").isNotNull()).alias("n_raw"), inference.guarded_corr("score", "a", 10).alias("r"))
    same(legs.select("run", "n_raw", F.col("pearson_raw").alias("r")), plain, ["run"], ["n_raw", "r"])
    same(legs.select("run", F.col("v").alias("rho")), rho("esc"), ["run"], ["rho"])
    for df in (got, legs):
        assert "Join" not in plan(df) and "Window" not in plan(df)


def test_levels_have_one_row_for_a_run_and_variant(series):
    grid = [0.0, 0.5, 1.0, 2.0, 3.0]
    got = calibrate.leading_levels(series, KEYS, (12,), {"both": ("form", "esc"), "form": ("form",)}, ["mean", "and", "var_only"], (2, 3), 50, grid).cache()
    assert got.count() == 8 * 2 * 3 * 2 and "Window" not in plan(got)
    for name, cls in (("both", ("form", "esc")), ("form", ("form",))):
        for how in ("mean", "and", "var_only"):
            rule = LeadingRule(window=12, classes=cls, sustain=3, start=50, combine=how)
            scores = alarms.score_series(series, KEYS, rule)
            mine = got.where(f"classes = '{name}' AND combine = '{how}' AND sustain = 3")
            want = alarms.leading_alarm(scores, KEYS, rule).select("run", F.col("sustained_score").alias("top"), F.col("lead_max_score").alias("most"))
            same(mine, want, ["run"], ["top", "most"])
            floors = alarms.sustained_floor(scores, KEYS, F.col("score"), 3, 50, "f")
            first = {(r.run, r.k): r.alarm_cycle for r in calibrate.alarm_by_threshold(floors, KEYS, "f", grid).collect()}
            assert {(r.run, k): c for r in mine.collect() for k, c in zip(grid, r.reached)} == first


def test_lagging_levels_equal_rows(series):
    grid, rule = [0.5, 1.0, 1.5], LaggingRule(baseline_end=50)
    got = calibrate.lagging_levels(series, KEYS, "form", rule, (2, 3), grid).where("sustain = 2")
    floors = alarms.sustained_floor(alarms.output_drop(series, KEYS, "form", rule), KEYS, F.col("drop"), 2, 50, "f")
    same(got, floors.groupBy("run").agg(F.max("f").alias("top")), ["run"], ["top"])
    first = {(r.run, r.k): r.alarm_cycle for r in calibrate.alarm_by_threshold(floors, KEYS, "f", grid, strict=True).collect()}
    assert {(r.run, k): c for r in got.collect() for k, c in zip(grid, r.reached)} == first
