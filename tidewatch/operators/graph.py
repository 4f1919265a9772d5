"""Windowed interaction graphs as edge tables keyed by cycle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.inference import cumulative_below
from tidewatch.session import cut_lineage

# Members of a team that one join key may hold; a larger team is cut into chunks.
CHUNK = 64
# Edges of a snapshot that are contracted together in a task; a larger snapshot is cut into hash chunks of about that many.
FOREST_EDGES = 500_000
# Cycles of a block whose snapshots one task contracts, and the most ties such a block may have; others take the tree of cells.
BLOCK_CYCLES = 16
BLOCK_TIES = 3_000_000


def team_pairs(members: DataFrame, keys: Sequence[str] = ("team", "cycle"), node: str = "node") -> DataFrame:
    """Undirected pairs ``(keys…, src, dst)``, src < dst, of the distinct members of each team.

    The pair is the result itself here (ties, cohesion, degree); connectivity uses :func:`star_edges` instead. A
    team above ``CHUNK`` members is cut into h hash chunks and each pair of chunks becomes a join key of its own,
    so no task ever holds more than two chunks and every pair is still made once.
    """
    keys = list(keys)
    sizes = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_h"))
    placed = members.join(sizes, keys).withColumn("_c", F.pmod(F.xxhash64(node), F.col("_h")).cast("int"))
    cells = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).select(
        *keys, node, "_c", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"))
    a = cells.select(*keys, "_i", "_j", F.col(node).alias("src"), F.col("_c").alias("_ca"))
    b = cells.select(*keys, "_i", "_j", F.col(node).alias("dst"), F.col("_c").alias("_cb"))
    inside = (F.least("_ca", "_cb") == F.col("_i")) & (F.greatest("_ca", "_cb") == F.col("_j"))
    return a.join(b, [*keys, "_i", "_j"]).where((F.col("src") < F.col("dst")) & inside).select(*keys, "src", "dst")


def star_edges(members: DataFrame, keys: Sequence[str] = ("team", "cycle"), node: str = "node") -> DataFrame:
    """Every member tied to one of its team: same components as all pairs, one edge per member.

    The hub of a team is drawn by hash, so no node is the hub of all the teams it belongs to."""
    hub = members.groupBy(*keys).agg(F.min_by(node, F.xxhash64(node, *keys)).alias("_hub"))
    spokes = members.join(hub, list(keys)).where(F.col(node) != F.col("_hub"))
    return spokes.select(*keys, F.least(node, "_hub").alias("src"), F.greatest(node, "_hub").alias("dst"))


def live_ties(edges: DataFrame, window: int, end_of_cycle: bool = False, last_cycle: int | None = None) -> DataFrame:
    """Live edges per cycle: rows ``(cycle, src, dst)``.

    A tie made in cycle a expires at a + window and is refreshed when made again. The start-of-cycle snapshot shows
    it from a + 1, the end-of-cycle snapshot from a. Each sighting is spread only up to the next one, so no
    duplicate is produced and raw sightings are what the exchange moves.
    """
    seen = edges.select("src", "dst", "cycle").distinct()
    nxt = F.lead("cycle").over(W.partitionBy("src", "dst").orderBy("cycle"))
    begin = F.col("cycle") if end_of_cycle else F.col("cycle") + 1
    stop = F.least(F.col("cycle") + window - 1, F.coalesce(F.col("_next") - 1 if end_of_cycle else F.col("_next"),
                                                           F.col("cycle") + window - 1))
    if last_cycle is not None:
        stop = F.least(stop, F.lit(last_cycle))
    spread = seen.withColumn("_next", nxt).withColumns({"_b": begin, "_e": stop}).where(F.col("_b") <= F.col("_e"))
    return spread.select(F.explode(F.sequence("_b", "_e")).alias("cycle"), "src", "dst")


def induced(edges: DataFrame, mask: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose two ends are both in the table ``mask(node)`` of visible nodes."""
    one = edges.join(mask.select(F.col("node").alias(src)), src, "left_semi")
    return one.join(mask.select(F.col("node").alias(dst)), dst, "left_semi").select(*edges.columns)


def degrees(live: DataFrame, by: Sequence[str] = ("cycle",)) -> DataFrame:
    return (live.withColumn("node", F.explode(F.array("src", "dst"))).groupBy(*by, "node")
            .agg(F.count(F.lit(1)).alias("degree")))


def smallest_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable over the edges (u, v) of every node 0..n-1: roots hook to smaller roots, trees are flattened."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def contracted(edges: DataFrame, by: str) -> DataFrame:
    """Rows ``(by, _chunk, node, comp)``: the components of each chunk of each snapshot's edges, which has a row a node.

    Tasks read their edges in the order of snapshots and chunks and hold those of a few chunks at a time.
    """
    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(rows: pd.DataFrame) -> pd.DataFrame:
            m = len(rows)
            cell = np.tile(rows[by].to_numpy(np.int64), 2)
            chunk, end = np.tile(rows["_chunk"].to_numpy(np.int64), 2), np.concatenate([rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64)])
            order = np.lexsort((end, chunk, cell))
            key = np.stack([cell[order], chunk[order], end[order]])
            first = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            number = np.empty(2 * m, np.int64)
            number[order] = np.cumsum(first) - 1
            cell, chunk, node = key[:, first]  # in ascending order, so the smallest number is the smallest node
            label = smallest_labels(number[:m], number[m:], len(node))
            return pd.DataFrame({by: cell, "_chunk": chunk, "node": node, "comp": node[label]})

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= FOREST_EDGES:
                whole = pd.concat(held, ignore_index=True)
                open_ = ((whole[by] == whole[by].iloc[-1]) & (whole["_chunk"] == whole["_chunk"].iloc[-1])).to_numpy()
                if not open_.all():
                    yield solved(whole[~open_])
                    whole = whole[open_].reset_index(drop=True)
                held, rows = [whole], len(whole)
        if rows:
            yield solved(pd.concat(held, ignore_index=True))

    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    dealt = edges.repartition(by, "_chunk").sortWithinPartitions(by, "_chunk")
    found = dealt.mapInPandas(contract, f"`{by}` bigint, _chunk bigint, node bigint, comp bigint")
    return found.select(F.col(by).cast(types[by]).alias(by), "_chunk", "node", "comp")


def connected_components(edges: DataFrame, by: str = "cycle", max_rounds: int = 60) -> DataFrame:
    """Component label (its smallest node) of every node that has an edge: rows ``(by, node, comp)``.

    A snapshot's edges are contracted in chunks of about ``FOREST_EDGES``. A snapshot of one chunk is done with that; from the
    chunks of a larger one an edge for each node and chunk is left, over which labels spread in rounds.
    """
    edges = edges.select(by, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    counts = edges.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOREST_EDGES)
    large = {r[by]: r["_n"] for r in counts.collect()}
    if not large:
        return contracted(edges.withColumn("_chunk", F.lit(0)), by).drop("_chunk")
    chunks = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, -(-n // FOREST_EDGES))])
    placed = edges.withColumn("_chunk", F.pmod(F.xxhash64("src", "dst"), F.coalesce(chunks[F.col(by)], F.lit(1))).cast("int"))
    parts = cut_lineage(contracted(placed, by))
    is_large = F.col(by).isin(*large)
    rest = parts.where(is_large).select(by, F.col("comp").alias("src"), F.col("node").alias("dst"))
    return parts.where(~is_large).drop("_chunk").unionByName(spread_labels(rest, by, max_rounds))


def spread_labels(edges: DataFrame, by: str, max_rounds: int) -> DataFrame:
    """Components of snapshots of any size: rows ``(by, node, comp)``. An edge may tie a node to itself.

    All snapshots advance together. A round takes the smallest label among the neighbours, hands it to the former
    label as well, and then follows labels once (label of my label), so chains shrink by more than half; it ends
    when no label moves. Lineage is cut in
    the shared checkpoint folder each round, so a lost executor repeats at most one.
    """
    e = cut_lineage(
        edges.select(by, F.explode(F.array(
            F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
            F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("p"))
        .select(by, "p.u", "p.v").distinct())
    labels = e.groupBy(by, F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp"))
    labels = cut_lineage(labels)
    for _ in range(max_rounds):
        near = e.join(labels.select(by, F.col("node").alias("v"), "comp"), [by, "v"]).groupBy(by, F.col("u").alias("node")).agg(
            F.min("comp").alias("_near"))
        seen = labels.join(near, [by, "node"]).select(by, "node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        # the smaller label is also offered to the node's former label, so whole trees move at once
        offers = seen.unionByName(seen.select(by, F.col("_old").alias("node"), F.lit(None).cast("bigint").alias("_old"), "comp"))
        hooked = offers.groupBy(by, "node").agg(F.max("_old").alias("_old"), F.min("comp").alias("comp"))
        jump = hooked.select(by, F.col("node").alias("comp"), F.col("comp").alias("_next"))
        moved = hooked.join(jump, [by, "comp"]).select(by, "node", F.col("_next").alias("comp"), (F.col("_next") != F.col("_old")).alias("_moved"))
        moved = cut_lineage(moved)
        labels = moved.select(by, "node", "comp")
        if moved.where("_moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def lifetimes(edges: DataFrame, window: int, end_of_cycle: bool = False) -> DataFrame:
    """Unbroken lifetimes ``(src, dst, b, e)`` of ties, in cycles of the snapshots :func:`live_ties` describes.

    Sightings of a tie that refresh it belong to one lifetime, however many there are.
    """
    seen = edges.select("src", "dst", "cycle").distinct()
    own = W.partitionBy("src", "dst").orderBy("cycle")
    gap = F.col("cycle") - F.lag("cycle").over(own)
    broken = F.when(gap <= (window if end_of_cycle else window - 1), 0).otherwise(1)
    runs = seen.withColumn("_new", broken).withColumn("_run", F.sum("_new").over(own))
    begin = F.min("cycle") + (0 if end_of_cycle else 1)
    return runs.groupBy("src", "dst", "_run").agg(begin.alias("b"), (F.max("cycle") + window - 1).alias("e")).where("b <= e").drop("_run")


def running_totals(spans: DataFrame, last_cycle: int, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over the live ties of every snapshot up to ``last_cycle``: rows ``(by…, cycle, until, <sums>)``.

    A row holds from ``cycle`` to before ``until``, the next snapshot at which a tie comes or goes. Ties are counted where they
    come and where they have gone, so a lifetime costs two rows however long it is.
    """
    by = list(by)
    ends = F.explode(F.array(F.struct(F.col("b").alias("cycle"), F.lit(1).alias("_sign")),
                             F.struct((F.least("e", F.lit(last_cycle)) + 1).alias("cycle"), F.lit(-1).alias("_sign"))))
    turns = spans.where(F.col("b") <= last_cycle).withColumn("_end", ends).withColumn("cycle", F.col("_end.cycle"))
    changes = turns.groupBy(*by, "cycle").agg(*[F.sum(F.col("_end._sign") * v).alias(c) for c, v in sums.items()])
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy("cycle")
    return changes.select(*by, "cycle", F.coalesce(F.lead("cycle").over(order), F.col("cycle")).alias("until"),
                          *[F.sum(c).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in sums])


def timeline_cells(spans: DataFrame, n_cycles: int, fanout: int = 4) -> DataFrame:
    """Lay lifetimes on a tree over cycles 0..n-1: rows ``(level, cell, src, dst)``.

    A cell of a level is an aligned stretch of fanout^level cycles. A lifetime is cut into the largest cells it covers, so
    it takes at most 2 (fanout - 1) rows a level, and every cycle of it lies in exactly one of them.
    """
    levels = 0
    while fanout ** levels < n_cycles:
        levels += 1

    def covered(level: int) -> tuple[Column, Column]:
        size = fanout ** level
        return F.ceil(F.col("b") / size).cast("int"), (F.floor((F.col("e") + 1) / size) - 1).cast("int")

    def cells(level: int) -> Column:
        lo, hi = covered(level)
        plain = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        if level == levels:
            return plain
        up_lo, up_hi = covered(level + 1)
        left, right = up_lo * fanout - 1, (up_hi + 1) * fanout
        before = F.when(lo <= left, F.sequence(lo, left)).otherwise(F.array().cast("array<int>"))
        after = F.when(right <= hi, F.sequence(right, hi)).otherwise(F.array().cast("array<int>"))
        return F.when(up_lo <= up_hi, F.concat(before, after)).otherwise(plain)

    inside = spans.select("src", "dst", F.greatest("b", F.lit(0)).alias("b"), F.least("e", F.lit(n_cycles - 1)).alias("e")).where("b <= e")
    placed = F.flatten(F.array(*[F.transform(cells(k), lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell"))) for k in range(levels + 1)]))
    return inside.select("src", "dst", F.explode(placed).alias("_c")).select("_c.level", "_c.cell", "src", "dst")


def block_snapshots(src: np.ndarray, dst: np.ndarray, b: np.ndarray, e: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cycle, node, comp) of every snapshot lo..hi, for the nodes with a tie; ties have two different ends.

    Ties that live through a stretch of cycles are contracted once, the others are handed to its halves with contracted ends.
    """
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)

    def halves(lo, hi, label, u, v, b, e):
        whole = (b <= lo) & (e >= hi)
        if whole.any():
            to = smallest_labels(u[whole], v[whole], len(label))
            label, u, v = to[label], to[u], to[v]
        if lo == hi:
            tied = np.bincount(label, minlength=len(label))[label] > 1
            if tied.any():
                yield lo, nodes[tied], nodes[label[tied]]
            return
        mid, open_ = (lo + hi) // 2, ~whole & (u != v)
        for first, last in ((lo, mid), (mid + 1, hi)):
            own = open_ & (b <= last) & (e >= first)
            yield from halves(first, last, label, u[own], v[own], b[own], e[own])

    yield from halves(lo, hi, np.arange(len(nodes)), ends[:len(src)], ends[len(src):], b, e)


def dynamic_components(spans: DataFrame, n_cycles: int, sizes: bool = False, fanout: int = 4) -> DataFrame:
    """Connected components of every snapshot of a graph whose ties, between different nodes, live from ``b`` to ``e``.

    Returns ``(cycle, node, comp)`` for every tied node, comp being the smallest node, or with ``sizes`` only
    ``(cycle, comp, s)``. Ties are dealt to the blocks of ``BLOCK_CYCLES`` cycles they live in, and a block is contracted in one
    task. Blocks of more than ``BLOCK_TIES`` ties are spread over many tasks by :func:`tree_components`.
    """
    width, most = BLOCK_CYCLES, BLOCK_TIES
    b, e = F.greatest("b", F.lit(0)).cast("int"), F.least("e", F.lit(n_cycles - 1)).cast("int")
    inside = cut_lineage(spans.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), b.alias("b"), e.alias("e")).where("b <= e"))
    dealt = inside.withColumn("_block", F.explode(F.sequence(F.floor(F.col("b") / width).cast("int"), F.floor(F.col("e") / width).cast("int"))))
    large = [r["_block"] for r in dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            lo = int(rows["_block"].iloc[0]) * width
            found = block_snapshots(*[rows[c].to_numpy() for c in ("src", "dst", "b", "e")], lo, min(lo + width, n_cycles) - 1)
            for cycle, node, comp in found:
                if sizes:
                    comp, s = np.unique(comp, return_counts=True)
                    yield pd.DataFrame({"cycle": cycle, "comp": comp, "s": s})
                else:
                    yield pd.DataFrame({"cycle": cycle, "node": node, "comp": comp})

        held: list[pd.DataFrame] = []
        for batch in batches:
            for own, rows in batch.groupby("_block"):  # tasks read block after block
                if held and held[0]["_block"].iloc[0] != own:
                    yield from block(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield from block(pd.concat(held, ignore_index=True))

    small = dealt.where(~F.col("_block").isin(large)) if large else dealt
    out = small.repartition("_block").sortWithinPartitions("_block").mapInPandas(
        solve, "cycle int, comp bigint, s bigint" if sizes else "cycle int, node bigint, comp bigint")
    if not large:
        return out
    first = F.col("_block") * width
    cut = dealt.where(F.col("_block").isin(large)).select(
        "src", "dst", F.greatest("b", first).alias("b"), F.least(F.col("e"), first + (width - 1)).alias("e"))
    return out.unionByName(tree_components(cut, n_cycles, sizes, fanout).select(*out.columns))


def tree_components(spans: DataFrame, n_cycles: int, sizes: bool = False, fanout: int = 4) -> DataFrame:
    """As :func:`dynamic_components`, with every snapshot spread over tasks. Lifetimes lie on a tree over the cycles (:func:`timeline_cells`) which is descended level by level:
    the ties of a cell are contracted once for all cycles under it, ties further down see contracted nodes, and those that
    have become loops are gone. All cells of a level advance together as one table keyed by cell. With ``sizes`` a cell holds
    its components with their number of nodes and no member is carried.
    """
    pieces = cut_lineage(timeline_cells(spans, n_cycles, fanout))  # a repeated piece is harmless
    levels = sorted((r.level for r in pieces.select("level").distinct().collect()), reverse=True)
    spark = spans.sparkSession
    carried, above = None, None

    def descended(table: DataFrame, down: int, level: int) -> DataFrame:
        """Rows of a level's cells repeated for the cells ``down`` levels below, without cells after the last cycle."""
        k = fanout ** down
        spread = table.withColumn("cell", F.explode(F.sequence(F.col("cell") * k, F.col("cell") * k + (k - 1))))
        return spread.where(F.col("cell").cast("bigint") * fanout ** level < n_cycles)

    for level in levels:
        labels = cut_lineage(connected_components(pieces.where(F.col("level") == level).select("cell", "src", "dst"), by="cell"))
        fresh = labels
        if carried is not None:
            below = descended(carried, above - level, level)
            to = labels.select("cell", F.col("node").alias("comp"), F.col("comp").alias("_to"))
            known = below.join(to, ["cell", "comp"], "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_to")
            fresh = labels.join(below.select("cell", F.col("comp").alias("node")).distinct(), ["cell", "node"], "left_anti")
        fresh = fresh.select("cell", "comp", F.lit(1).cast("bigint").alias("s")) if sizes else fresh.select("cell", "node", "comp")
        carried = fresh if carried is None else known.unionByName(fresh)
        if sizes:
            carried = carried.groupBy("cell", "comp").agg(F.sum("s").alias("s"))
        carried, above = cut_lineage(carried), level
        if level != levels[-1]:
            rest = pieces.where(F.col("level") < level).withColumn("_up", F.floor(F.col("cell") / F.pow(F.lit(fanout), level - F.col("level"))).cast("int"))
            for end in ("src", "dst"):
                to = labels.select(F.col("cell").alias("_up"), F.col("node").alias(end), F.col("comp").alias("_to"))
                rest = rest.join(to, ["_up", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            rest = rest.where("src <> dst").select("level", "cell", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            pieces = cut_lineage(rest)
    if carried is None:
        return spark.createDataFrame([], "cycle int, comp bigint, s bigint" if sizes else "cycle int, node bigint, comp bigint")
    if above:
        carried = descended(carried, above, 0)
    return carried.withColumnRenamed("cell", "cycle")


def on_all_cycles(df: DataFrame, n_cycles: int, empty: dict[str, Column]) -> DataFrame:
    """Complete a per-cycle table to cycles 0..n-1, filling a cycle without rows with ``empty``."""
    axis = df.sparkSession.range(n_cycles).select(F.col("id").cast("int").alias("cycle"))
    return axis.join(df, "cycle", "left").select("cycle", *[F.coalesce(F.col(c), v).alias(c) for c, v in empty.items()])


def component_summary(components: DataFrame, n_nodes: Column, by: str = "cycle", n_cycles: int | None = None) -> DataFrame:
    """Giant fraction and susceptibility per snapshot; nodes without an edge are components of size one.
    ``components`` has a row for each node, or for each component with its size ``s``.

    Susceptibility is the mean component size seen by a node outside the giant component; every component as large
    as the largest is left out, and 0 stands for an empty remainder.
    """
    sizes = components if "s" in components.columns else components.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("s"))
    hist = sizes.groupBy(by, "s").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(by)
    tied = F.sum(F.col("s") * F.col("n")).over(w)
    top = F.greatest(F.max("s").over(w), F.lit(1))
    h = hist.withColumns({"_top": top, "_alone": n_nodes - tied})
    rest = F.when(F.col("s") != F.col("_top"), F.col("n"))
    s1 = F.coalesce(F.sum(rest * F.col("s")), F.lit(0)) + F.max(F.when(F.col("_top") > 1, F.col("_alone")).otherwise(0))
    s2 = F.coalesce(F.sum(rest * F.col("s") * F.col("s")), F.lit(0)) + F.max(F.when(F.col("_top") > 1, F.col("_alone")).otherwise(0))
    out = h.groupBy(by).agg(F.max("_top").alias("giant"), F.max("_alone").alias("isolated"), F.sum("n").alias("n_components"),
                            F.when(s1 > 0, s2 / s1).otherwise(F.lit(0.0)).alias("susceptibility"))
    if n_cycles is None:
        return out
    return on_all_cycles(out, n_cycles, {"giant": F.lit(1), "isolated": n_nodes, "n_components": F.lit(0), "susceptibility": F.lit(0.0)})


def quantile(df: DataFrame, by: Sequence[str], x: str, q: float, out: str = "q", buckets: int = 256) -> DataFrame:
    """Exact interpolated quantile per group from counted values: no group is ordered by one task."""
    by = list(by)
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    placed = cumulative_below(counts, by, x, ["n"], buckets)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    pos = q * (F.col("_total") - 1)
    covers = lambda p: (F.col("below_n") <= p) & (p < F.col("below_n") + F.col("n"))
    j = placed.join(total, by)
    lo, hi = F.max(F.when(covers(F.floor(pos)), F.col(x))), F.max(F.when(covers(F.ceil(pos)), F.col(x)))
    frac = F.max(pos - F.floor(pos))
    return j.groupBy(*by).agg((lo + (hi - lo) * frac).alias(out))


def weighted_score(events: DataFrame, key: str, x: str, time: str = "cycle", tie: str = "team", alpha: float = 0.15, width: int = 4096) -> DataFrame:
    """Exponentially weighted score of every key, one update an event: rows ``(key, score, n_updates)``.

    An update s <- (1 - alpha) s + alpha x is an affine map, and the maps of consecutive events compose to one. Events are
    taken in the order of ``time``, then of the whole number ``tie``; those of one time and one stretch of ``width`` numbers are
    a block, which is ordered by itself. A block becomes one map (its number of events and its weighted sum), and a suffix
    scan over a key's blocks tells how far each one is damped. The score starts at 0. Events whose ``x`` is NULL update nothing.
    """
    known = events.where(F.col(x).isNotNull()).withColumn("_block", F.floor(F.col(tie) / width))
    own = W.partitionBy(key, time, "_block").orderBy(F.col(tie).desc())
    damp = lambda n: F.pow(F.lit(1 - alpha), n)
    maps = known.withColumn("_age", F.row_number().over(own) - 1).groupBy(key, time, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.lit(alpha) * damp(F.col("_age")) * F.col(x)).alias("_b"))
    later = W.partitionBy(key).orderBy(F.col(time).desc(), F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    placed = maps.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    return placed.groupBy(key).agg(F.sum(F.col("_b") * damp(F.col("_after"))).alias("score"), F.sum("_n").alias("n_updates"))
