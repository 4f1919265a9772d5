"""Rows outside the declared axis, wide kernels, missing admissible thresholds, withdrawals and late cycles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibrate, rolling
from tidewatch.operators.alarms import LeadingRule
from tidewatch.session import shared_dir
from tidewatch.sources import tables as T
from tidewatch.streaming import streams as L


def test_densify_keeps_every_cycle_once(spark):
    df = spark.createDataFrame([("a", c, float(c)) for c in (-3, 0, 2, 4, 5, 7)] + [("b", c, float(c)) for c in (-1, 2, 9)], "k string, cycle int, y double")
    got = {(r.k, r.cycle): r.y for r in T.densify(df, ["k"], 5).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): None, ("a", 2): 2.0, ("a", 3): None, ("a", 4): 4.0, **{("b", c): 2.0 if c == 2 else None for c in range(5)}}
    assert df.groupBy("k").agg(T.outside_axis(F.col("cycle"), 5).alias("n")).orderBy("k").collect() == [("a", 3), ("b", 2)]


def test_kernel_reach_follows_the_bandwidth(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "cycle": np.arange(300), "y": y}))
    t = np.arange(300)
    w = np.exp(-0.5 * ((t[:, None] - t[None, :]) / 40) ** 2)
    got = [r.r for r in rolling.kernel_residual(df, ["k"], bandwidth=40.0).orderBy("cycle").collect()]
    assert np.allclose(got, y - (w @ y) / w.sum(axis=1), atol=1e-9)


def test_kernel_residual_in_blocks_equals_the_whole_series(spark, monkeypatch):
    monkeypatch.setattr(rolling, "KERNEL_BLOCK", 64)
    rng = np.random.default_rng(5)
    t = np.arange(-70, 230)
    y = np.where(rng.random(300) < 0.3, np.nan, rng.normal(size=300))
    rows = [("a", int(c), None if np.isnan(v) else float(v)) for c, v in zip(t, y)] + [("b", c, 1.0 if c < 4 else None) for c in range(9)]
    out = rolling.kernel_residual(spark.createDataFrame(rows, "k string, cycle int, y double"), ["k"])
    assert "collect_list(CASE" not in out._jdf.queryExecution().optimizedPlan().toString()  # no list of neighbours for every row
    got = {(r.k, r.cycle): r.r for r in out.collect()}
    near = abs(t[:, None] - t[None, :]) <= 85
    w = np.where(near & ~np.isnan(y)[None, :], np.exp(-0.5 * ((t[:, None] - t[None, :]) / 10) ** 2), 0)
    r = y - w @ np.nan_to_num(y) / w.sum(axis=1)
    assert len(got) == len(rows) and all(got["b", c] is None for c in range(9))
    for c, v in zip(t, r):
        assert got["a", c] is None if np.isnan(v) else abs(got["a", c] - v) < 1e-9


def test_no_admissible_threshold_is_an_error(spark):
    curve = spark.createDataFrame([(1.0, 9, 10, 0.9), (2.0, 5, 10, 0.5)], "k double, n_false int, n int, fpr double")
    assert calibrate.smallest_admissible(curve, [], 0.6).first().k == 2.0
    with pytest.raises(Exception, match="no threshold of the grid"):
        calibrate.smallest_admissible(curve, [], 0.1).collect()


def test_earlier_withdrawals_stay_withdrawn(spark, tmp_path):
    store = spark.createDataFrame([(1, 0, 0, 10.0), (2, 0, 0, 20.0), (3, 0, 0, 30.0), (4, 1, 0, 7.0)], "user_id long, shard int, cycle int, value double")
    base = str(tmp_path)
    store.groupBy("shard", "cycle").agg(F.avg("value").alias("y")).write.parquet(f"{base}/table/version=0")
    seen = []
    for user in (1, 2, 4):
        spark.createDataFrame([(user,)], "user_id long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("user_id long").parquet(f"{base}/in")
        L.rederive_on_revocation(stream, store, f"{base}/table", "shard", "user_id", f"{base}/cp")
        seen.append({r.shard: r.y for r in L.latest_version(spark, f"{base}/table", "shard").collect()})
    assert seen == [{0: 25.0, 1: 7.0}, {0: 30.0, 1: 7.0}, {0: 30.0, 1: 7.0}]


def series():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(size=70), 6 * rng.normal(size=50)])


def alarms(spark, parts, delay, name):
    path = f"{shared_dir(spark)}/{name}"
    rule = LeadingRule(window=10, classes=("y",), k=1.0, sustain=2, start=40, max_gap=0)
    y = series()
    for cycles in parts:
        spark.createDataFrame([("a", int(c), float(y[c])) for c in cycles], "key string, cycle int, y double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key string, cycle int, y double").option("maxFilesPerTrigger", 1).parquet(path)
    return [tuple(r)[:2] for r in L.run_available(L.sustained_alarms(stream, "key", rule, delay), name).collect()]


def test_late_cycles_do_not_move_the_alarm(spark):
    import uuid

    name = f"late-{uuid.uuid4().hex}"
    whole = alarms(spark, [range(120)], 0, f"{name}-whole")
    assert len(whole) == 1
    late = alarms(spark, [range(30), range(60, 90), range(30, 60), range(90, 120)], 60, f"{name}-late")
    assert late in (whole, [])  # judged once a cycle 60 later is in
    assert alarms(spark, [range(30), range(60, 90), range(30, 60), range(90, 120)], 35, f"{name}-some") == whole
    with pytest.raises(Exception, match="raise delay"):
        alarms(spark, [range(30), range(60, 90), range(30, 60)], 0, f"{name}-none")


def test_rules_that_the_state_cannot_hold_are_refused(spark):
    df = spark.createDataFrame([], "key string, cycle int, y double")
    for rule in (LeadingRule(), LeadingRule(classes=("y",), max_gap=3), LeadingRule(classes=("y",), max_gap=0, combine="and")):
        with pytest.raises(ValueError, match="streamed rule"):
            L.sustained_alarms(df, "key", rule)
