"""Queries over the temporal team graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions import columns as C
from tidewatch.functions.columns import rnd
from tidewatch.operators import graph as G
from tidewatch.operators.rolling import pooled_trailing_mean
from tidewatch.plans.registry import query
from tidewatch.session import cut_lineage
from tidewatch.sources import teams as M
from tidewatch.sources.tables import ORDER_DAYS, densify, table
from tidewatch.sources.teams import COVERAGE, EVENTS_SQL, LINK_WINDOW, MEMBERS_SQL, TIE_WINDOW, VISIBLE_SQL

BASE = f"WITH RECURSIVE {MEMBERS_SQL}"
PAIRS_SQL = """
pairs AS (SELECT a.team, a.cycle, a.node AS src, b.node AS dst FROM members a JOIN members b ON a.team = b.team AND a.node < b.node)"""


def live_sql(end: bool, src: str = "pairs", name: str = "live", window: int = TIE_WINDOW) -> str:
    first = 0 if end else 1
    return f"""
{name} AS (SELECT DISTINCT CAST(p.cycle + r.range AS INTEGER) AS cycle, src, dst FROM {src} p, range({first}, {window}) r WHERE p.cycle + r.range < {ORDER_DAYS})"""


def components_sql(edges: str, name: str = "comps") -> str:
    """The smallest label reaches a node over the edges of its cycle; a row is replaced while a smaller one arrives."""
    return f"""
{name}_e AS (SELECT cycle, src AS u, dst AS v FROM {edges} UNION SELECT cycle, dst, src FROM {edges}),
{name}(cycle, node, comp) USING KEY (cycle, node) AS (SELECT DISTINCT cycle, u, u FROM {name}_e UNION
  SELECT e.cycle, e.v, min(r.comp) FROM {name} r JOIN {name}_e e ON e.cycle = r.cycle AND e.u = r.node
  JOIN recurring.{name} k ON k.cycle = e.cycle AND k.node = e.v WHERE r.comp < k.comp GROUP BY 1, 2)"""


def summary_sql(comps: str, n_nodes: str, name: str = "summary") -> str:
    return f"""
{name}_s AS (SELECT cycle, comp, count(*) AS s FROM {comps} GROUP BY 1, 2),
{name}_t AS (SELECT cycle, max(s) AS giant, sum(s) AS tied, count(*) AS nc FROM {name}_s GROUP BY 1),
{name}_o AS (SELECT cycle, s, 1 AS m FROM {name}_s UNION ALL SELECT cycle, 1, {n_nodes} - tied FROM {name}_t),
{name} AS (SELECT o.cycle, any_value(t.giant) AS giant, CAST(any_value({n_nodes} - t.tied) AS BIGINT) AS isolated, any_value(nc) AS n_components,
  coalesce(sum(s * s * m) FILTER (WHERE s <> giant) / nullif(sum(s * m) FILTER (WHERE s <> giant), 0), 0)::DOUBLE AS susceptibility FROM {name}_o o JOIN {name}_t t USING (cycle) GROUP BY 1
  UNION ALL SELECT CAST(range AS INTEGER), 1, CAST({n_nodes} AS BIGINT), 0, 0.0 FROM range({ORDER_DAYS}) WHERE range NOT IN (SELECT cycle FROM {name}_t))"""


def pairs(spark, sf_dir):
    return G.team_pairs(M.members(spark, sf_dir))


def visible_nodes(spark, sf_dir):
    return M.nodes(spark, sf_dir).where(M.visible())


def start_components(spark, sf_dir, members=None, sizes=False):
    members = M.members(spark, sf_dir) if members is None else members
    return G.dynamic_components(G.lifetimes(G.star_edges(members), TIE_WINDOW), ORDER_DAYS, sizes)


@query("team_pairs", BASE + "," + PAIRS_SQL + " SELECT src, dst, count(*) AS times, min(cycle) AS first_cycle, max(cycle) AS last_cycle FROM pairs GROUP BY 1, 2")
def team_pairs(spark, sf_dir):
    """Canonical undirected pairs of team members with how often they met."""
    return pairs(spark, sf_dir).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("times"), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"))


@query("live_ties", BASE + "," + PAIRS_SQL + "," + live_sql(False, window=5) + " SELECT cycle, count(*) AS n_edges, CAST(sum(src + dst) AS BIGINT) AS id_sum FROM live GROUP BY 1")
def live_ties(spark, sf_dir):
    """Edges live at the start of every cycle under a five-cycle sliding tie window with refresh."""
    live = G.running_totals(G.lifetimes(pairs(spark, sf_dir), 5), ORDER_DAYS - 1, [], {"n_edges": F.lit(1), "id_sum": F.col("src") + F.col("dst")})
    return live.where("n_edges > 0").select(F.explode(F.sequence("cycle", F.col("until") - 1)).alias("cycle"), "n_edges", "id_sum")


@query("mean_degree", BASE + "," + PAIRS_SQL + "," + live_sql(True) + f""",
vis AS (SELECT s_suppkey AS node FROM (SELECT s_suppkey, s_suppkey AS node FROM supplier) WHERE {VISIBLE_SQL}),
n AS (SELECT (SELECT count(*) FROM supplier) AS n_all, (SELECT count(*) FROM vis) AS n_vis)
SELECT cycle, count(src) AS n_edges, count(*) FILTER (WHERE src IN (SELECT node FROM vis) AND dst IN (SELECT node FROM vis)) AS n_visible_edges,
  round(2.0 * count(src) / any_value(n_all), 9) AS mean_degree,
  round(2.0 * count(*) FILTER (WHERE src IN (SELECT node FROM vis) AND dst IN (SELECT node FROM vis)) / any_value(n_vis), 9) AS obs_mean_degree
FROM (SELECT CAST(range AS INTEGER) AS cycle FROM range(2405)) LEFT JOIN live USING (cycle), n GROUP BY 1""")
def mean_degree(spark, sf_dir):
    """End-of-cycle mean degree of the whole graph and of the subgraph on visible nodes, in one pass."""
    both = F.when(M.visible(node="src") & M.visible(node="dst"), 1).otherwise(0)
    live = G.running_totals(G.lifetimes(pairs(spark, sf_dir), TIE_WINDOW, end_of_cycle=True), ORDER_DAYS - 1, [],
                            {"n_edges": F.lit(1), "n_visible_edges": both})
    live = live.where("n_edges > 0").select(F.explode(F.sequence("cycle", F.col("until") - 1)).alias("cycle"), "n_edges", "n_visible_edges")
    counts = M.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(M.visible()).alias("v"))
    g = G.on_all_cycles(live, ORDER_DAYS, {"n_edges": F.lit(0), "n_visible_edges": F.lit(0)})
    return g.withColumns({
        "mean_degree": rnd(F.try_divide(2.0 * F.col("n_edges"), counts.select("n").scalar()), 9),
        "obs_mean_degree": rnd(F.try_divide(2.0 * F.col("n_visible_edges"), counts.select("v").scalar()), 9)})


@query("node_degrees", BASE + "," + PAIRS_SQL + "," + live_sql(True) + """
SELECT node, count(*) AS active_cycles, max(d) AS max_degree, round(avg(d), 9) AS mean_degree FROM
 (SELECT cycle, node, count(*) AS d FROM (SELECT cycle, src AS node FROM live UNION ALL SELECT cycle, dst FROM live) GROUP BY 1, 2) GROUP BY 1""")
def node_degrees(spark, sf_dir):
    """Degree of every node over the cycles in which it has a tie."""
    spans = G.lifetimes(pairs(spark, sf_dir), TIE_WINDOW, end_of_cycle=True).withColumn("node", F.explode(F.array("src", "dst")))
    d = G.running_totals(spans, ORDER_DAYS - 1, ["node"], {"degree": F.lit(1)}).where("degree > 0").withColumn("cycles", F.col("until") - F.col("cycle"))
    return d.groupBy("node").agg(F.sum("cycles").alias("active_cycles"), F.max("degree").alias("max_degree"),
                                 rnd(F.sum(F.col("degree") * F.col("cycles")) / F.sum("cycles"), 9).alias("mean_degree"))


COMPS = BASE + "," + PAIRS_SQL + "," + live_sql(False) + "," + components_sql("live")


@query("components", COMPS + " SELECT cycle, node, comp FROM comps")
def components(spark, sf_dir):
    """Connected components of the live graph at the start of every cycle."""
    return start_components(spark, sf_dir)


@query("giant_component", COMPS + "," + summary_sql("comps", "(SELECT count(*) FROM supplier)") + """
SELECT cycle, giant, round(1.0 * giant / (SELECT count(*) FROM supplier), 9) AS giant_frac, isolated, n_components, round(susceptibility, 9) AS susceptibility FROM summary""")
def giant_component(spark, sf_dir):
    """Giant fraction and susceptibility per cycle, isolated nodes counted as components."""
    n = M.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    s = G.component_summary(start_components(spark, sf_dir, sizes=True), n.scalar(), n_cycles=ORDER_DAYS)
    return s.select("cycle", "giant", rnd(F.col("giant") / n.scalar(), 9).alias("giant_frac"), "isolated", "n_components", rnd("susceptibility", 9).alias("susceptibility"))


VIS_COMPS = f"""WITH RECURSIVE {MEMBERS_SQL.replace('members AS', 'allm AS')}, members AS (SELECT * FROM allm WHERE {VISIBLE_SQL}),""" + PAIRS_SQL + "," + live_sql(False) + "," + components_sql("live")
N_VIS = f"(SELECT count(*) FROM (SELECT s_suppkey AS node FROM supplier) WHERE {VISIBLE_SQL})"


@query("observed_giant_component", VIS_COMPS + "," + summary_sql("comps", N_VIS) + f"""
SELECT cycle, giant, round(1.0 * giant / {N_VIS}, 9) AS obs_giant_frac, isolated, round(susceptibility, 9) AS obs_susceptibility FROM summary""")
def observed_giant_component(spark, sf_dir):
    """The same on the subgraph induced by visible nodes, against the number of visible nodes."""
    seen = M.members(spark, sf_dir).join(visible_nodes(spark, sf_dir), "node", "left_semi").select("team", "cycle", "node")
    n = visible_nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    s = G.component_summary(start_components(spark, sf_dir, seen, sizes=True), n.scalar(), n_cycles=ORDER_DAYS)
    return s.select("cycle", "giant", rnd(F.try_divide("giant", n.scalar()), 9).alias("obs_giant_frac"), "isolated", rnd("susceptibility", 9).alias("obs_susceptibility"))


@query("visible_subgraph", BASE + "," + PAIRS_SQL + f""",
vis AS (SELECT node FROM (SELECT s_suppkey AS node FROM supplier) WHERE {VISIBLE_SQL})
SELECT src, dst, count(*) AS times FROM pairs WHERE src IN (SELECT node FROM vis) AND dst IN (SELECT node FROM vis) GROUP BY 1, 2""")
def visible_subgraph(spark, sf_dir):
    """Pairs with both ends visible, through two semi joins with the mask."""
    return G.induced(pairs(spark, sf_dir), mask=visible_nodes(spark, sf_dir)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))


@query("team_cohesion", BASE + "," + PAIRS_SQL + "," + live_sql(False, window=30) + """
SELECT p.team, count(*) AS n_pairs, count(l.src) AS n_tied, round(1.0 * count(l.src) / count(*), 9) AS cohesion
FROM pairs p LEFT JOIN live l ON l.cycle = p.cycle AND l.src = p.src AND l.dst = p.dst GROUP BY 1""")
def team_cohesion(spark, sf_dir):
    """Share of a team's pairs that already hold a live tie; the tie window is a range test on the last meeting.

    A pair is tied at a cycle iff it last met within the window before it, so a lag over the pair's own history
    answers the question without spreading ties over cycles or joining them.
    """
    p = pairs(spark, sf_dir)
    met = p.select("src", "dst", "cycle").distinct()
    last = F.lag("cycle").over(W.partitionBy("src", "dst").orderBy("cycle"))
    tied = met.withColumn("tied", F.coalesce(F.col("cycle") - last <= 29, F.lit(False)))
    return p.join(tied, ["src", "dst", "cycle"]).groupBy("team").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("tied").alias("n_tied"), rnd(F.avg(F.col("tied").cast("double")), 9).alias("cohesion"))


REACH = COMPS + f""",{EVENTS_SQL},
esc AS (SELECT e.team, e.cycle, min(m.node) AS node, any_value(n_regionkey) AS pathway FROM team_events e JOIN members m USING (team) JOIN orders o ON o.o_orderkey = e.team
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE urgent GROUP BY 1, 2),
links AS (SELECT DISTINCT CAST(e.cycle + r.range AS INTEGER) AS cycle, pathway, node FROM esc e, range(1, {LINK_WINDOW}) r),
lc AS (SELECT DISTINCT l.cycle, l.pathway, coalesce(c.comp, l.node) AS comp FROM links l LEFT JOIN comps c USING (cycle, node)),
tc AS (SELECT DISTINCT m.team, m.cycle, coalesce(c.comp, m.node) AS comp FROM members m LEFT JOIN comps c USING (cycle, node))"""


@query("pathway_reach", REACH + """
SELECT t.team, count(DISTINCT l.pathway) AS reach FROM tc t LEFT JOIN lc l USING (cycle, comp) GROUP BY 1""")
def pathway_reach(spark, sf_dir):
    """Distinct pathways with a live member in any component of a team."""
    members = M.members(spark, sf_dir)
    comps = cut_lineage(start_components(spark, sf_dir, members))  # read twice
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    path = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("o_orderkey").alias("team"), F.col("n_regionkey").alias("pathway"))
    esc = members.join(path, "team").groupBy("team", "cycle", "pathway").agg(F.min("node").alias("node"))
    links = esc.select("pathway", "node", F.explode(F.sequence(F.col("cycle") + 1, F.col("cycle") + LINK_WINDOW - 1)).alias("cycle")).distinct()
    placed = lambda df: df.join(comps, ["cycle", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))
    # pathways are few: a component's live pathways fit one small set
    lc = placed(links).groupBy("cycle", "comp").agg(F.collect_set("pathway").alias("paths"))
    tc = placed(members).select("team", "cycle", "comp").distinct()
    found = tc.join(lc, ["cycle", "comp"], "left").withColumn("p", F.explode_outer("paths"))
    return found.groupBy("team").agg(F.count_distinct("p").alias("reach"))


@query("observed_dyads", f"WITH {MEMBERS_SQL},{EVENTS_SQL}," + f"""
t AS (SELECT level, e.cycle, e.team, count(*) AS m, count(*) FILTER (WHERE {VISIBLE_SQL}) AS k FROM members JOIN team_events e USING (team) GROUP BY 1, 2, 3),
c AS (SELECT level, cycle, sum(k * (k - 1) / 2) AS obs, sum(m * (m - 1) / 2) AS alls FROM t GROUP BY 1, 2)
SELECT level, cycle, CAST(obs AS BIGINT) AS obs_dyads, round(sum(obs) OVER w / nullif(sum(alls) OVER w, 0), 9) AS achieved_edge_frac FROM c
WINDOW w AS (PARTITION BY level ORDER BY cycle)""")
def observed_dyads(spark, sf_dir):
    """Observed dyads per cycle and the running achieved fraction of all dyads."""
    m = M.members(spark, sf_dir)
    t = m.groupBy("team", "cycle").agg(F.count(F.lit(1)).alias("m"), F.count_if(M.visible()).alias("k"))
    t = t.join(M.team_events(spark, sf_dir).select("team", "level"), "team")
    dyads = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    c = t.groupBy("level", "cycle").agg(dyads("k").alias("obs"), dyads("m").alias("all"))
    w = W.partitionBy("level").orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    return c.select("level", "cycle", F.col("obs").cast("bigint").alias("obs_dyads"),
                    rnd(F.try_divide(F.sum("obs").over(w), F.sum("all").over(w)), 9).alias("achieved_edge_frac"))


@query("open_close_output", f"WITH {EVENTS_SQL}," + f"""
c AS (SELECT level, cycle + {M.PROGRAM_DAYS} AS cycle, sum(value) AS s, count(*) AS n FROM team_events GROUP BY 1, 2),
g AS (SELECT level, CAST(range AS INTEGER) AS cycle FROM (SELECT DISTINCT level FROM team_events), range({ORDER_DAYS + M.PROGRAM_DAYS})),
d AS (SELECT level, cycle, s, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (level, cycle))
SELECT level, cycle, CAST(sum(n) OVER w AS BIGINT) AS output_n, round(CASE WHEN sum(n) OVER w > 0 THEN sum(s) OVER w / sum(n) OVER w END, 6) AS output_close FROM d
WINDOW w AS (PARTITION BY level ORDER BY cycle ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def open_close_output(spark, sf_dir):
    """Values land a fixed delay after they open; the output is their pooled mean over ten cycles."""
    e = M.team_events(spark, sf_dir)
    c = e.groupBy("level", (F.col("cycle") + M.PROGRAM_DAYS).alias("cycle")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    out = pooled_trailing_mean(densify(c, ["level"], ORDER_DAYS + M.PROGRAM_DAYS), ["level"], "s", "n", 10, "m")
    return out.select("level", "cycle", F.col("m_n").alias("output_n"), rnd("m").alias("output_close"))


@query("centrality", f"WITH {MEMBERS_SQL}," + """
t AS (SELECT team, count(*) AS m FROM members GROUP BY 1), d AS (SELECT node, sum(m - 1) AS deg FROM members JOIN t USING (team) GROUP BY 1),
f AS (SELECT s_suppkey AS node, coalesce(deg, 0) AS deg FROM supplier LEFT JOIN d ON d.node = s_suppkey)
SELECT node, CAST(deg AS BIGINT) AS cum_degree, round((deg - (SELECT avg(deg) FROM f)) / (SELECT CASE WHEN stddev_pop(deg) > 1e-9 THEN stddev_pop(deg) ELSE 1 END FROM f), 9) AS z FROM f""")
def centrality(spark, sf_dir):
    """Cumulative degree of every node, standardised over all nodes."""
    return centrality_z(spark, sf_dir).select("node", F.col("deg").alias("cum_degree"), rnd("z", 9).alias("z"))


def centrality_z(spark, sf_dir):
    m = M.members(spark, sf_dir)
    size = m.groupBy("team").agg(F.count(F.lit(1)).alias("m"))
    d = m.join(size, "team").groupBy("node").agg(F.sum(F.col("m") - 1).alias("deg"))
    f = M.nodes(spark, sf_dir).join(d, "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    s = f.agg(F.avg("deg").alias("mean"), F.stddev_pop("deg").alias("sd"))
    sd = s.select(F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)).scalar()
    return f.withColumn("z", (F.col("deg") - s.select("mean").scalar()) / sd)


@query("final_observed_degree", f"""WITH {MEMBERS_SQL},{PAIRS_SQL},
vis AS (SELECT node FROM (SELECT s_suppkey AS node FROM supplier) WHERE {VISIBLE_SQL}), last AS (SELECT max(cycle) AS c FROM members),
l AS (SELECT DISTINCT src, dst FROM pairs, last WHERE cycle > c - 30 AND src IN (SELECT node FROM vis) AND dst IN (SELECT node FROM vis))
SELECT s_suppkey AS node, (SELECT count(*) FROM l WHERE src = s_suppkey OR dst = s_suppkey) AS observed_degree FROM supplier""")
def final_observed_degree(spark, sf_dir):
    """Degree of every node among visible nodes in the last snapshot of a thirty-cycle tie window."""
    m = M.members(spark, sf_dir)
    last = m.agg(F.max("cycle").alias("c")).scalar()
    recent = m.where(F.col("cycle") > last - 30).join(visible_nodes(spark, sf_dir), "node", "left_semi").select("team", "cycle", "node")
    ties = G.team_pairs(recent).select("src", "dst").distinct().withColumn("one", F.lit(1))
    d = G.degrees(ties, ["one"]).select("node", "degree")
    return M.nodes(spark, sf_dir).join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("observed_degree"))


@query("newcomers", f"""WITH {MEMBERS_SQL}, f AS (SELECT node, min(cycle) AS first FROM members GROUP BY 1)
SELECT cycle, count(DISTINCT team) AS n_teams, count(*) AS n_members, count(*) FILTER (WHERE cycle = first) AS n_newcomers FROM members JOIN f USING (node) GROUP BY 1""")
def newcomers(spark, sf_dir):
    """Members seen for the first time, per cycle."""
    m = M.members(spark, sf_dir)
    first = m.groupBy("node").agg(F.min("cycle").alias("first"))
    return m.join(first, "node").groupBy("cycle").agg(
        F.count_distinct("team").alias("n_teams"), F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("cycle") == F.col("first")).alias("n_newcomers"))


SCORE = f"""WITH {MEMBERS_SQL},{EVENTS_SQL},
a AS (SELECT m.node, value AS x, row_number() OVER (PARTITION BY m.node ORDER BY m.cycle DESC, m.team DESC) - 1 AS age FROM members m JOIN team_events e USING (team)),
sc AS (SELECT node, sum(0.15 * power(0.85, age) * x) AS score, count(*) AS n_updates FROM a GROUP BY 1)"""


def member_scores(spark, sf_dir):
    m, e = M.members(spark, sf_dir), M.team_events(spark, sf_dir).select("team", "value")
    return G.weighted_score(m.join(e, "team"), "node", "value")


@query("weighted_score", SCORE + " SELECT node, round(score, 6) AS score, n_updates FROM sc")
def weighted_score(spark, sf_dir):
    """Exponentially weighted score of every member, updated by each of its events in turn."""
    return member_scores(spark, sf_dir).select("node", rnd("score").alias("score"), "n_updates")


@query("bottom_quantile", SCORE + " SELECT node, round(score, 6) AS score FROM sc WHERE score <= (SELECT quantile_cont(score, 0.2) FROM sc)")
def bottom_quantile(spark, sf_dir):
    """Members in the lowest fifth of the score, the threshold interpolated exactly."""
    s = member_scores(spark, sf_dir)
    q = G.quantile(s.withColumn("all", F.lit(1)), ["all"], "score", 0.2)
    return s.where(F.col("score") <= q.select("q").scalar()).select("node", rnd("score").alias("score"))


@query("longest_inactive", f"""WITH {MEMBERS_SQL}, l AS (SELECT node, max(cycle) AS last_active FROM members GROUP BY 1)
SELECT node, last_active, (SELECT max(cycle) FROM members) - last_active AS idle FROM l ORDER BY last_active, node LIMIT 5""")
def longest_inactive(spark, sf_dir):
    """The five members inactive for longest."""
    m = M.members(spark, sf_dir)
    last = m.groupBy("node").agg(F.max("cycle").alias("last_active"))
    return last.orderBy("last_active", "node").limit(5).withColumn("idle", m.agg(F.max("cycle")).scalar() - F.col("last_active"))
