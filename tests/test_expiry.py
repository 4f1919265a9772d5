"""Streamed lifetimes and scores by blocks of maps against loops."""

import datetime as dt
import random

from tidewatch.operators import graph
from tidewatch.streaming import expiry, streams

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "u long, v string, ts timestamp"


def brute_lifetimes(sightings, window, closed):
    days = {}
    for u, v, ts in sightings:
        c = (ts - T0).days
        if u is not None and v is not None and c < closed:
            days.setdefault((u, v), set()).add(c)
    out = []
    for key, seen in days.items():
        first = last = None
        for c in sorted(seen):
            if first is not None and c - last >= window:
                out.append((*key, first, last))
                first = None
            first, last = c if first is None else first, c
        if last + window <= closed:
            out.append((*key, first, last))
    return sorted(out)


def test_streamed_lifetimes_over_several_batches(spark, tmp_path):
    """Rows within the delay come in any order; keys that fall silent are reported without input of their own."""
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.choice("ab"), T0 + dt.timedelta(hours=rng.randrange(60 * 24))) for _ in range(150)]
    rows += [(99, "a", T0 + dt.timedelta(days=1)), (None, "a", T0 + dt.timedelta(days=2)), (3, None, T0 + dt.timedelta(days=2)), (99, "a", T0 + dt.timedelta(days=1, hours=3))]
    rows.sort(key=lambda r: r[2] + dt.timedelta(hours=rng.randrange(40)))  # late by up to 40 hours
    for i in range(5):
        spark.createDataFrame(rows[i * 31:(i + 1) * 31], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with expiry.timed_state(spark):
        out = streams.run_available(expiry.lifetimes(stream, ["u", "v"], 4, "2024-01-01", delay="48 hours"), "test-expiry")
    closed = (max(r[2] for r in rows) - dt.timedelta(hours=48) - T0).days
    assert sorted(map(tuple, out.collect())) == brute_lifetimes(rows, 4, closed)


def test_score_is_updated_by_each_event_in_turn(spark):
    rng = random.Random(1)
    events = [(rng.randrange(4), rng.randrange(6), i, rng.random() if rng.random() > 0.1 else None) for i in range(300)]
    events.append((9, 0, 5, None))
    expected = {}
    for k, c, i, x in sorted(events, key=lambda e: (e[1], e[2])):
        if x is not None:
            s, n = expected.get(k, (0.0, 0))
            expected[k] = (0.85 * s + 0.15 * x, n + 1)
    df = spark.createDataFrame(events, "k int, cycle int, team long, x double")
    for width in (1, 7, 4096):  # whatever the blocks
        got = {r.k: (r.score, r.n_updates) for r in graph.weighted_score(df, "k", "x", width=width).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k][0] - expected[k][0]) < 1e-12 and got[k][1] == expected[k][1] for k in got)


def test_lifetimes_keep_no_python_state(spark, tmp_path, capfd):
    """A key costs rows of Spark's own windowed state, not calls of a Python worker for each key and timer."""
    spark.createDataFrame([(i, "a", T0 + dt.timedelta(days=d)) for i in range(3) for d in (0, 4, 5, 9, 30)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = expiry.lifetimes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), ["u", "v"], 5, "2024-01-01")
    stream.explain()
    assert "Python" not in capfd.readouterr().out and "Pandas" not in str(stream._jdf.queryExecution().logical())
    with expiry.timed_state(spark):
        out = streams.run_available(stream, "test-expiry-plan")
    assert sorted(map(tuple, out.collect())) == [(i, "a", 0, 9) for i in range(3)]
