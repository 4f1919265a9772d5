import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import mixed
from tidewatch.functions.intervals import two_proportion_z, wilson
from tidewatch.functions.tails import _chi2, chi2_upper, normal_two_sided
from tidewatch.operators import cells, checks, graph, inference, mixture, recovery, resample, visibility
from tidewatch.plans import ORACLES, QUERIES, load_all, resampling


def test_multiplicity_golden(spark):
    df = spark.createDataFrame([("f", p) for p in (0.04, 0.001, 0.02, 0.2)], "family STRING, p DOUBLE")
    rows = {r["p"]: (r["holm_p"], r["bh_p"]) for r in inference.adjust_p(df, ["family"]).collect()}
    want = {0.04: (0.08, 0.04 * 4 / 3), 0.001: (0.004, 0.004), 0.02: (0.06, 0.04), 0.2: (0.2, 0.2)}
    for p, (h, b) in want.items():
        assert rows[p] == (pytest.approx(h), pytest.approx(b))


def test_chi2_critical_values(spark):
    # fixed values: published upper 5 % and 1 % points
    for df, x05, x01 in ((1, 3.841459, 6.634897), (2, 5.991465, 9.210340), (3, 7.814728, 11.344867), (10, 18.307038, 23.209251),
                         (15, 24.995790, 30.577914), (20, 31.410433, 37.566235)):
        assert _chi2(x05, df) == pytest.approx(0.05, abs=1e-7)
        assert _chi2(x01, df) == pytest.approx(0.01, abs=1e-7)
    row = spark.createDataFrame([(2.0, 4.0, 4.0)], "z DOUBLE, x DOUBLE, d DOUBLE").select(
        normal_two_sided("z").alias("p"), chi2_upper("x", "d").alias("q")).first()
    assert row["p"] == pytest.approx(math.erfc(2 / math.sqrt(2))) and row["q"] == pytest.approx(3 * math.exp(-2))


def test_copies_do_not_add_groups(spark):
    runs = spark.createDataFrame([(g, i, g == 1) for g in (1, 2) for i in range(9)], "grp INT, copy INT, fired BOOLEAN")
    g = cells.collapse_copies(runs, ["grp"], ["fired"]).collect()
    assert len(g) == 2 and {r["size"] for r in g} == {9} and {r["fired_mean"] for r in g} == {0.0, 1.0}


def test_strict_collapse_raises(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "g INT, x DOUBLE")
    with pytest.raises(Exception, match="disagree"):
        df.groupBy("g").agg(cells.strict_value("x").alias("v")).collect()


def test_wilson_and_z_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 5.0), (3.0, 10.0, 5.0, 10.0), (0.0, 10.0, 0.0, 10.0)], "k DOUBLE, n DOUBLE, j DOUBLE, m DOUBLE")
    r = df.select(wilson("k", "n", -1).alias("lo"), wilson("k", "n", 1).alias("hi"), two_proportion_z("k", "n", "j", "m").alias("z")).collect()
    assert r[0]["lo"] is None and r[0]["z"] is None and r[2]["z"] is None
    assert (r[1]["lo"], r[1]["hi"]) == (pytest.approx(0.1077913, abs=1e-6), pytest.approx(0.6032219, abs=1e-6))


def test_numbering_follows_the_hash(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("s"), F.col("id").alias("key"))
    a = {(r.s, r.key): r.idx for r in resample.dense_index(df, ["s"], "key").collect()}
    order = sorted(range(1, 3000, 3), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    assert [a[1, k] for k in order] == list(range(1000))
    assert sorted(v for (s, _), v in a.items() if s == 1) == list(range(1000))


def test_slots_are_uniform(spark):
    slots = spark.range(20000).select((mixed(F.col("id") * 7919 + 77) % 10).alias("b")).groupBy("b").count().collect()
    assert len(slots) == 10
    assert sum((r["count"] - 2000) ** 2 / 2000 for r in slots) < 30


def test_bootstrap_error_near_theory(spark):
    x = np.random.default_rng(1).normal(5, 2, 200)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "s INT, key INT, x DOUBLE")
    r = resample.bootstrap_mean(df, ["s"], "key", "x", 400, 9).first()
    se = x.std(ddof=1) / math.sqrt(200)
    assert r["mean"] == pytest.approx(x.mean()) and r["se"] == pytest.approx(se, rel=0.15) and r["lo95"] < r["mean"] < r["hi95"]
    p = resample.percentile_interval(resample.poisson_sums(df, ["s"], "key", ["x"], 400, 9).withColumn("m", F.col("x") / F.col("n")), ["s"], "m").first()
    assert p["se"] == pytest.approx(se, rel=0.15)


def test_bootstrap_mean_takes_all_draws_of_all_groups(spark, monkeypatch):
    """2,000 draws, as the study's bootstrap of a mean has; the query and its SQL took 1,000."""
    seen, sums = [], resample.bootstrap_sums
    monkeypatch.setattr(resample, "bootstrap_sums", lambda *a: seen.append(sums(*a)) or seen[-1])
    load_all()
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["bootstrap_mean"](spark, sf).collect()
    drawn = {(r.c, r.arm): (r.draws, r.n) for r in seen[0].groupBy("c", "arm").agg(F.count_distinct("draw").alias("draws"), F.max("n").alias("n")).collect()}
    groups = resampling.group_leads(spark, sf).groupBy("c", "arm").count().collect()
    assert drawn == {(r.c, r.arm): (2000, r["count"]) for r in groups} and len(rows) == len(groups)
    assert "range(2000) d" in ORACLES["bootstrap_mean"]


def test_poisson_weights_are_hashed_once_and_follow_the_number(spark):
    df = spark.range(300).select(F.lit(1).alias("s"), F.col("id").alias("key"), F.col("id").cast("double").alias("x"))
    sums = resample.poisson_sums(df, ["s"], "key", ["x"], 40, 9)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1  # once for every comparison before
    u = lambda d, k: int(hashlib.md5(f"poisson9|{d}|{k}".encode()).hexdigest()[:8], 16) / 2 ** 32
    for r in sums.collect():
        w = [sum(u(r.draw, k) > p for p in resample.POISSON_CDF) for k in range(300)]
        assert (r.n, r.x) == (sum(w), sum(k * v for k, v in enumerate(w)))


def test_rate_trend_ties_do_not_depend_on_the_order_of_sums(spark, tmp_path):
    import os

    import duckdb
    from check_queries import check
    from tidewatch.plans import load_all
    load_all()
    src = "/root/testdata/sf0.1"
    # copies whose keys move through the coverages: every coverage has the same rate
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + i * 1501 AS user_id) FROM range(8) r(i), '{src}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ok, text = check(spark, con, "rate_trend", os.fspath(tmp_path))
    assert ok, text


@pytest.mark.parametrize("buckets", [None, 16])
def test_ranks_with_ties(spark, buckets):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, 300), rng.integers(0, 9, 300)
    df = spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(x, y)], "g INT, x INT, y INT")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = inference.spearman(df, ["g"], "x", "y", buckets).first()["rho"]
    assert got == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    a = inference.auc(df, ["g"], "x", F.col("y") >= 5, buckets).first()["auc"]
    p, q = x[y >= 5], x[y < 5]
    assert a == pytest.approx(np.mean([(i > j) + 0.5 * (i == j) for i in p for j in q]))
    assert graph.quantile(df, ["g"], "x", 0.2).first()["q"] == pytest.approx(np.quantile(x, 0.2))


def test_large_team_pairs_are_whole(spark):
    members = spark.createDataFrame([(1, 0, n) for n in range(200)] + [(2, 0, n) for n in (3, 1, 2)], "team INT, cycle INT, node BIGINT")
    pairs = graph.team_pairs(members)
    assert pairs.where("team = 1").count() == 200 * 199 // 2 and pairs.where("team = 1").distinct().count() == 200 * 199 // 2
    assert {(r.src, r.dst) for r in pairs.where("team = 2").collect()} == {(1, 2), (1, 3), (2, 3)}


def test_tie_window_and_components(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 2, 2), (5, 6, 0)], "src BIGINT, dst BIGINT, cycle INT")
    start = {(r.cycle, r.src) for r in graph.live_ties(e, 3).collect()}
    assert start == {(1, 1), (2, 1), (3, 1), (4, 1), (1, 5), (2, 5)}
    end = {(r.cycle, r.src) for r in graph.live_ties(e, 3, end_of_cycle=True).collect()}
    assert end == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (0, 5), (1, 5), (2, 5)}
    chain = spark.createDataFrame([(i * 7 % 40, (i + 1) * 7 % 40, 0) for i in range(39)] + [(100, 101, 0), (100, 101, 1)], "src BIGINT, dst BIGINT, cycle INT")
    comps = {(r.cycle, r.node): r.comp for r in graph.connected_components(chain).collect()}
    assert {v for (c, n), v in comps.items() if n < 40} == {0} and comps[0, 101] == 100 and comps[1, 101] == 100
    two = spark.createDataFrame([(1, 2, 0), (3, 4, 0)], "src BIGINT, dst BIGINT, cycle INT")
    s = graph.component_summary(graph.connected_components(two), F.lit(5)).first()
    assert (s["giant"], s["isolated"], s["susceptibility"]) == (2, 1, 1.0)  # tied giants are both left out


def test_mixture_follows_em(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(6, 0.5, 40)])
    df = spark.createDataFrame([("a", float(v)) for v in x], "g STRING, x DOUBLE")
    r = mixture.two_component_bic(df, "g", "x", max_iter=60, tol=1e-6).first()
    assert r["two_component_preferred"] and r["m1"] == pytest.approx(x[:60].mean(), abs=0.2) and r["weight_1"] == pytest.approx(0.6, abs=0.02)


def test_propensity_fit_equals_newton(spark):
    rng = np.random.default_rng(6)
    d = rng.integers(0, 20, 400)
    seen = rng.random(400) < 1 / (1 + np.exp(-(d - 10) / 4))
    df = spark.createDataFrame([(int(a), bool(b)) for a, b in zip(d, seen)], "deg INT, visible BOOLEAN")
    fit = visibility.propensity_fit(df, "visible", "deg")
    x = np.column_stack([np.ones(400), (d - d.mean()) / d.std()])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (seen - p) - 1e-3 * w)
    assert (fit["intercept"], fit["slope"]) == (pytest.approx(w[0], abs=1e-5), pytest.approx(w[1], abs=1e-5))


def test_gap_and_checks(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 1.5, 9.0, 9.5, 20.0)], "g STRING, x DOUBLE")
    assert recovery.largest_gap(df, ["g"], "x").first()["largest_gap"] == 10.5
    other = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.0)], "g STRING, x DOUBLE")
    assert checks.table_difference(df, df).isEmpty() and checks.table_difference(df, other).count() == 5
    bad = checks.recompute_differences(other.where("g = 'a' AND x = 1"), other.where("g = 'b'"), ["g"], ["x"])
    assert {r["problem"] for r in bad.collect()} == {"only stored", "only fresh"}


def test_a_step_of_the_mixture_fit_is_one_small_job(spark):
    """Rows stay where they are: a step brings seven sums for a group to the driver and writes nothing."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(2.5, 1, 300)])
    rows = [(g, float(v)) for g in ("a", "b") for v in x] + [("one", 4.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    sc = spark.sparkContext
    sc.setJobGroup("mixture-fit", "")
    fit = {r["g"]: r for r in mixture.two_component_bic(df, "g", "x", max_iter=30, tol=1e-12).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("mixture-fit"))
    sc.setJobGroup("", "")
    assert fit["a"]["iterations"] == fit["b"]["iterations"] == 30 and fit["one"]["iterations"] == 1 and len(fit) == 3
    pi, m1, s1, m2, s2 = 0.5, *(f(h) for h in np.split(np.sort(x), 2) for f in (np.mean, np.std))
    for _ in range(30):
        p, q = pi * np.exp(-0.5 * ((x - m1) / s1) ** 2) / s1, (1 - pi) * np.exp(-0.5 * ((x - m2) / s2) ** 2) / s2
        w = p / (p + q)
        pi, m1, m2 = w.mean(), (w @ x) / w.sum(), ((1 - w) @ x) / (1 - w).sum()
        s1, s2 = np.sqrt(w @ (x - m1) ** 2 / w.sum()), np.sqrt((1 - w) @ (x - m2) ** 2 / (1 - w).sum())
    assert [fit["a"][k] for k in ("weight_1", "m1", "m2", "s1", "s2")] == pytest.approx([pi, m1, m2, s1, s2], abs=1e-9)
    assert jobs <= 2 * 30 + 30, jobs
