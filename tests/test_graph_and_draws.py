"""Components under a tie window, block bootstrap and keyed permutations against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph, resample


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("fanout, n_cycles", [(2, 37), (4, 64), (4, 50)])
def test_dynamic_components_equal_every_snapshot(spark, fanout, n_cycles):
    rng = random.Random(fanout + n_cycles)
    spans = []
    for _ in range(130):
        b = rng.randrange(-5, n_cycles)
        a, c = rng.sample(range(40), 2)
        spans.append((min(a, c), max(a, c), b, b + rng.choice([0, 1, 3, 20, 90])))
    table = spark.createDataFrame(spans, "src long, dst long, b int, e int")
    expected = {(t, node): comp for t in range(n_cycles) for node, comp in union_find([(a, c) for a, c, b, e in spans if b <= t <= e]).items()}
    got = graph.dynamic_components(table, n_cycles, fanout=fanout).collect()
    assert len(got) == len(expected) and {(r.cycle, r.node): r.comp for r in got} == expected
    sizes = {(r.cycle, r.comp): r.s for r in graph.dynamic_components(table, n_cycles, sizes=True, fanout=fanout).collect()}
    assert sizes == Counter((t, comp) for (t, _), comp in expected.items())


def test_small_snapshots_settle_without_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, *sorted(rng.sample(range(60 * (t + 1)), 2))) for t in range(5) for _ in range(45 * (t + 1))]
    expected = {(t, n): c for t in range(5) for n, c in union_find([(a, b) for u, a, b in rows if u == t]).items()}
    edges = spark.createDataFrame([*rows, *rows[:9]], "cycle int, src long, dst long")
    found = lambda: {(r.cycle, r.node): r.comp for r in graph.connected_components(edges).collect()}
    monkeypatch.setattr(graph, "FOREST_EDGES", 100)  # some snapshots in chunks
    assert found() == expected

    def no_rounds(*_):
        raise AssertionError("a round for snapshots that fit a task")

    monkeypatch.setattr(graph, "FOREST_EDGES", 1000)
    monkeypatch.setattr(graph, "spread_labels", no_rounds)
    assert found() == expected


@pytest.mark.parametrize("most", [0, 75, 1000])
def test_blocks_of_any_size_equal_every_snapshot(spark, monkeypatch, most):
    rng = random.Random(most)
    n_cycles, spans = 37, []
    for _ in range(170):
        b = rng.randrange(-5, n_cycles)
        a, c = rng.sample(range(40), 2)
        spans.append((min(a, c), max(a, c), b, b + rng.choice([0, 1, 3, 20, 90])))
    expected = {(t, node): comp for t in range(n_cycles) for node, comp in union_find([(a, c) for a, c, b, e in spans if b <= t <= e]).items()}
    table = spark.createDataFrame(spans, "src long, dst long, b int, e int")
    trees, tree = [], graph.tree_components
    monkeypatch.setattr(graph, "BLOCK_TIES", most)
    monkeypatch.setattr(graph, "tree_components", lambda *args: trees.append(1) or tree(*args))
    got = graph.dynamic_components(table, n_cycles).collect()
    assert len(got) == len(expected) and {(r.cycle, r.node): r.comp for r in got} == expected
    sizes = {(r.cycle, r.comp): r.s for r in graph.dynamic_components(table, n_cycles, sizes=True).collect()}
    assert sizes == Counter((t, comp) for (t, _), comp in expected.items())
    assert len(trees) == (0 if most == 1000 else 2)  # the tree of cells is only for blocks that do not fit a task


def test_dynamic_components_of_nothing(spark):
    table = spark.createDataFrame([(1, 2, 9, 12)], "src long, dst long, b int, e int")
    assert graph.dynamic_components(table, 5).collect() == []
    assert graph.dynamic_components(table, 5, sizes=True).collect() == []


@pytest.mark.parametrize("end_of_cycle", [False, True])
def test_lifetimes_spread_to_live_ties(spark, end_of_cycle):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(3), 5 + rng.randrange(2), rng.randrange(40)) for _ in range(60)], "src long, dst long, cycle int")
    for window in (1, 4):
        spans = graph.lifetimes(edges, window, end_of_cycle)
        spread = spans.select(F.explode(F.sequence("b", "e")).alias("cycle"), "src", "dst")
        live = graph.live_ties(edges, window, end_of_cycle)
        assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, live.collect()))
        # lifetimes of a tie neither meet nor overlap
        rows = sorted((r.src, r.dst, r.b, r.e) for r in spans.collect())
        assert all(p[:2] != q[:2] or q[2] > p[3] + 1 for p, q in zip(rows, rows[1:]))


@pytest.mark.parametrize("end_of_cycle", [False, True])
def test_running_totals_equal_counts_of_live_ties(spark, end_of_cycle):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(4), 5 + rng.randrange(3), rng.randrange(-4, 45)) for _ in range(70)], "src long, dst long, cycle int")
    live = [tuple(r) for r in graph.live_ties(edges, 6, end_of_cycle, last_cycle=39).collect()]
    spans = graph.lifetimes(edges, 6, end_of_cycle)
    node = graph.running_totals(spans.withColumn("node", F.explode(F.array("src", "dst"))), 39, ["node"], {"d": F.lit(1)}).collect()
    got = {(r.node, t): r.d for r in node for t in range(r.cycle, r.until) if r.d}
    assert got == Counter((x, t) for t, a, b in live for x in (a, b))
    rows = graph.running_totals(spans, 39, [], {"n": F.lit(1), "ids": F.col("src") + F.col("dst")}).collect()
    assert len(rows) <= 2 * spans.count()  # a row for each change, not for each cycle of each tie
    assert {t: (r.n, r.ids) for r in rows for t in range(r.cycle, r.until) if r.n} == {
        t: (len(own), sum(own)) for t in {t for t, _, _ in live} for own in [[a + b for u, a, b in live if u == t]]}


def test_hubs_of_a_node_s_teams_differ(spark):
    members = spark.createDataFrame([(t, 0, n) for t in range(60) for n in (1, 2, 3, 4)], "team int, cycle int, node long")
    edges = graph.star_edges(members).collect()
    assert len(edges) == 180 and all(r.src < r.dst for r in edges)
    degree = Counter(x for r in edges for x in (r.src, r.dst))
    assert max(degree.values()) < 180  # the smallest node would be in every one of them


# ------------------------------------------------------------------------------------------------------------------- draws
def test_block_counts_split_every_draw(spark):
    n, size, draws = 1003, 50, 400
    counts = np.stack([resample.block_counts(5, "s", n, b, draws, size) for b in range(21)])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    rows = np.array([50] * 20 + [3])
    # multinomial: mean n p and variance n p (1 - p), within five standard errors
    p = rows / n
    assert (abs(counts.mean(axis=1) - rows) < 5 * np.sqrt(rows * (1 - p) / draws)).all()
    assert (abs(counts.var(axis=1) / (rows * (1 - p)) - 1) < 5 * np.sqrt(2 / draws) + 0.15).all()
    assert (resample.block_counts(5, "other", n, 0, draws, size) != counts[0]).any()
    assert (resample.block_counts(5, "s", 40, 0, draws, size) == 40).all()


def test_blocked_bootstrap_is_a_resample_whatever_the_partitioning(spark):
    rows = [("a", f"k{i}", float(i), None if i % 3 else 1.0) for i in range(500)] + [("b", "only", 7.0, None)]
    df = spark.createDataFrame(rows, "s string, key string, x double, y double")
    run = lambda t, size: {(r.s, r.draw): (r.n, r.x, r.y) for r in resample.bootstrap_sums(t, ["s"], "key", ["x", "y"], 300, 11, size).collect()}
    got = run(df, 64)
    assert got == run(df.repartition(13, "key"), 64)
    assert len(got) == 600 and {got["b", d] for d in range(300)} == {(1, 7.0, None)}
    mean = np.array([got["a", d][1] / 500 for d in range(300)])
    spread = np.std(np.arange(500)) / np.sqrt(500)
    assert abs(mean.mean() - 249.5) < 5 * spread / np.sqrt(300) and abs(mean.std() / spread - 1) < 0.2
    # one block: the rows that the slot numbers name, as SQL repeats it
    whole = run(df, 4096)
    order = sorted(range(500), key=lambda i: __import__("hashlib").md5(f"k{i}".encode()).hexdigest())
    for d in (0, 7):
        idx = resample.slot_numbers(11, np.full(500, d), np.arange(500)) % 500
        assert whole["a", d][1] == sum(float(order[i]) for i in idx)


@pytest.mark.parametrize("at_once", [300, 4000])
def test_bootstrap_of_many_blocks_draws_the_rows_that_sql_names(spark, monkeypatch, at_once):
    monkeypatch.setattr(resample, "AT_ONCE", at_once)  # pieces of a draw, or of several draws
    n, draws = 700, 20
    df = spark.createDataFrame([("a", f"k{i}", float(i), None if i < 690 else 1.0) for i in range(n)] + [(None, "lost", 1.0, 1.0)], "s string, key string, x double, y double")
    got = {r.draw: (r.s, r.n, r.x, r.y) for r in resample.bootstrap_sums(df, ["s"], "key", ["x", "y"], draws, 11, 64).collect()}
    order = sorted(range(n), key=lambda i: __import__("hashlib").md5(f"k{i}".encode()).hexdigest())
    for d in range(draws):
        rows = [order[i] for i in resample.slot_numbers(11, np.full(n, d), np.arange(n)) % n]
        assert got[d] == ("a", n, float(sum(rows)), float(sum(i >= 690 for i in rows)) or None)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000])
def test_keyed_place_is_a_bijection(spark, n):
    draws = spark.range(n).select(F.col("id").alias("idx"), F.lit(n).cast("long").alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199))))
    placed = resample.with_keyed_place(draws.withColumn("k", resample.round_key(3, F.col("draw"))), "idx", "n", "k", "p").collect()
    places = {}
    for r in placed:
        places.setdefault(r.draw, {})[r.idx] = r.p
    assert all(sorted(x.values()) == list(range(n)) for x in places.values())
    if 5 <= n <= 12:  # every row is as likely at every place
        seen = Counter((i, x[i]) for x in places.values() for i in range(n))
        chi = sum((seen[i, j] - 200 / n) ** 2 / (200 / n) for i in range(n) for j in range(n))
        assert chi < (n - 1) ** 2 + 6 * np.sqrt(2) * (n - 1)
