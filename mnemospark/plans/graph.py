"""Graph queries over causal links and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as X
from mnemospark.operators import cycles as C
from mnemospark.operators import graph as G
from mnemospark.plans.registry import query
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))


def _links(spark, sf, least: float = 0.0):
    return T.causal_links(spark, sf).where(F.col("strength") >= least).select(F.col("cause_id").alias("a"), F.col("effect_id").alias("b"), "strength", "evidence_count")


def _undirected(spark, sf):
    return T.associations(spark, sf).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed long")


REACH = ", r(id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT effect_id, depth + 1 FROM r JOIN causal_links ON cause_id = id WHERE depth < {d} AND strength >= {s})"


@query("g01_bfs", ctes("causal_links", recursive=True) + REACH.format(d=3, s=0.4) + " SELECT id, min(depth) AS depth FROM r GROUP BY id")
def bfs(spark, sf):
    return G.reach(_links(spark, sf, 0.4), _seed(spark, 5), 3).select("id", "depth")


@query("g02_reachable", ctes("causal_links", recursive=True) + REACH.format(d=4, s=0.4) + " SELECT DISTINCT id FROM r")
def reachable(spark, sf):
    return G.reach(_links(spark, sf, 0.4), _seed(spark, 5), 4).select("id")


@query("g03_causal_chain_filtered", ctes("causal_links", recursive=True) + REACH.format(d=2, s=0.6) + " SELECT id, min(depth) AS depth FROM r GROUP BY id")
def causal_only(spark, sf):
    return G.reach(_links(spark, sf, 0.6), _seed(spark, 5), 2).select("id", "depth")


@query("g04_context_by_depth", ctes("causal_links", recursive=True) + REACH.format(d=3, s=0.4) + ", m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT depth, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM m GROUP BY depth")
def context_by_depth(spark, sf):
    r = G.reach(_links(spark, sf, 0.4), _seed(spark, 5), 3)
    return r.groupBy("depth").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("g05_paths", ctes("causal_links", recursive=True) + ", w(path, last) AS (SELECT [cause_id, effect_id], effect_id FROM causal_links WHERE cause_id = 5 AND strength >= 0.4 UNION ALL SELECT list_append(path, effect_id), effect_id FROM w JOIN causal_links ON cause_id = last WHERE last <> 9 AND len(path) < 4 AND strength >= 0.4 AND NOT list_contains(path, effect_id)) SELECT array_to_string(path, '>') AS path FROM w WHERE last = 9")
def find_paths(spark, sf):
    p = G.paths(_links(spark, sf, 0.4), 5, 9, 3)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


BOTH = ", u AS (SELECT a_id AS a, b_id AS b FROM associations WHERE a_id <> b_id UNION SELECT b_id, a_id FROM associations WHERE a_id <> b_id)"


@query("g06_adjacency", ctes("associations") + BOTH + " SELECT a, b FROM u")
def adjacency(spark, sf):
    return G.both_ways(_undirected(spark, sf))


@query("g07_degree_centrality", ctes("associations") + BOTH + " SELECT a AS id, round(count(*) * 1.0 / ((SELECT count(DISTINCT a) FROM u) - 1), 6) AS centrality FROM u GROUP BY a")
def degree_centrality(spark, sf):
    u = G.both_ways(_undirected(spark, sf))
    n = u.select("a").distinct().agg(rows().alias("n"))
    return u.groupBy(F.col("a").alias("id")).agg(rows().alias("deg")).crossJoin(F.broadcast(n)).select("id", S.rounded(F.col("deg") / (F.col("n") - 1)).alias("centrality"))  # n: one row


PAGERANK = ctes("associations", recursive=True) + BOTH + """, d AS (SELECT a, count(*) AS deg FROM u GROUP BY a), n AS (SELECT count(*) AS n FROM d),
r(i, id, rank) AS (SELECT 0, a, 1.0::DOUBLE / n FROM d, n UNION ALL SELECT r.i + 1, b, 0.15 / any_value(n) + 0.85 * sum(rank / deg) FROM r JOIN d ON d.a = r.id JOIN u ON u.a = r.id, n WHERE r.i < 100 GROUP BY r.i, b),
m AS (SELECT y.i AS i, sum(abs(y.rank - x.rank)) AS moved FROM r x JOIN r y ON y.id = x.id AND y.i = x.i + 1 GROUP BY 1)
SELECT id, round(rank, 6) AS rank FROM r WHERE i = (SELECT coalesce(min(i), 100) FROM m WHERE moved < 1e-6)"""


@query("g08_pagerank", PAGERANK)
def pagerank(spark, sf):
    """Ranks after at most 100 rounds, or when a round moves less than 1e-6."""
    return G.pagerank(_undirected(spark, sf)).select("id", S.rounded("rank").alias("rank"))


def _betweenness_sql(depth: int) -> str:
    """Shortest paths of up to ``depth`` steps counted level by level, then the share of each node on them."""
    out = ctes("associations") + ", u AS (SELECT a_id AS a, b_id AS b FROM associations WHERE a_id <> b_id AND strength >= 0.2 UNION SELECT b_id, a_id FROM associations WHERE a_id <> b_id AND strength >= 0.2), l0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS t, 1.0::DOUBLE AS paths FROM u)"
    for d in range(1, depth + 1):
        near = f"SELECT s, t FROM l{d - 1}" + (f" UNION ALL SELECT s, t FROM l{d - 2}" if d > 1 else "")
        out += f", l{d} AS MATERIALIZED (SELECT s, b AS t, sum(paths) AS paths FROM l{d - 1} JOIN u ON t = a WHERE (s, b) NOT IN ({near}) GROUP BY s, b)"
    out += ", p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, t, {d} AS d, paths FROM l{d}" for d in range(depth + 1)) + "), n AS (SELECT count(*) AS n FROM l0)"
    return out + ", x AS (SELECT v.t AS id, sum(v.paths * w.paths / e.paths) AS score FROM p e JOIN p v ON v.s = e.s JOIN p w ON w.s = v.t AND w.t = e.t WHERE v.d + w.d = e.d AND v.d > 0 AND w.d > 0 GROUP BY 1) SELECT l0.t AS id, round(coalesce(score, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) AS score FROM l0 LEFT JOIN x ON x.id = l0.t, n"


@query("g09_betweenness", _betweenness_sql(30))
def betweenness(spark, sf):
    e = T.associations(spark, sf).where("strength >= 0.2").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return G.betweenness(e, G.both_ways(e).select(F.col("a").alias("id")).distinct()).select("id", S.rounded("score").alias("score"))


@query("g10_recency_weights", ctes("actions") + ", l AS (SELECT k, max(executed_at) AS t FROM actions GROUP BY k), n AS (SELECT max(executed_at) AS now FROM actions) SELECT k AS id, round(least(1.0, greatest(0.1, exp(-ln(2) / 30 * floor((epoch_us(now) - epoch_us(t)) / 86400000000.0)))), 6) AS weight FROM l, n")
def recency_weights(spark, sf):
    a = T.actions(spark, sf)
    now = T.as_of(a, "executed_at")
    l = a.groupBy(F.col("k").alias("id")).agg(F.max("executed_at").alias("t"))
    return l.select("id", S.rounded(S.half_life_weight(S.hours_between(F.lit(now), "t") / 24)).alias("weight"))


@query("g11_would_create_cycle", ctes("causal_links", recursive=True) + ", e AS (SELECT cause_id AS a, effect_id AS b FROM causal_links WHERE strength >= 0.4), r(seed, id, depth) AS (SELECT DISTINCT b, b, 0 FROM e UNION SELECT seed, b, depth + 1 FROM r JOIN e ON a = id WHERE depth < 10), w AS (SELECT DISTINCT seed, id FROM r) SELECT a, b, id IS NOT NULL AS cyclic FROM e LEFT JOIN w ON seed = b AND id = a")
def would_create_cycle(spark, sf, depth: int = 10):
    """Every edge: whether a way of up to ten steps leads back."""
    e = _links(spark, sf, 0.4)
    return C.closing(e, e, depth)


def _chain_sql(depth: int) -> str:
    out = ctes("causal_links") + ", l0 AS (SELECT 5::BIGINT AS id, 0 AS depth, NULL::BIGINT AS parent, 1.0::DOUBLE AS strength)"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        out += f", l{d} AS (SELECT effect_id AS id, {d} AS depth, cause_id AS parent, c.strength FROM causal_links c JOIN l{d - 1} ON cause_id = id WHERE c.strength >= 0.3 AND effect_id NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY effect_id ORDER BY c.strength DESC, cause_id) = 1)"
    return out + " " + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))


@query("g12_causal_chain", _chain_sql(3))
def causal_chain(spark, sf):
    return G.chain(_links(spark, sf, 0.3), 5, 3)


@query("g13_predict_outcome", ctes("causal_links") + ", w AS (SELECT cause_id, effect_id, strength * least(evidence_count / 10.0, 1.0) AS w FROM causal_links WHERE strength >= 0.4), g AS (SELECT cause_id, effect_id, w / sum(w) OVER (PARTITION BY cause_id) AS p, row_number() OVER (PARTITION BY cause_id ORDER BY w DESC, effect_id) AS rn FROM w) SELECT cause_id, effect_id, round(p, 6) AS probability FROM g WHERE rn <= 5")
def predict_outcome(spark, sf):
    from mnemospark.operators.topk import ranked

    w = _links(spark, sf, 0.4).withColumn("w", F.col("strength") * F.least(F.col("evidence_count") / 10.0, F.lit(1.0)))
    total = w.groupBy("a").agg(F.sum("w").alias("total"))
    top = ranked(w, ["a"], [F.desc("w"), F.col("b")], 5).join(total, "a")
    return top.select(F.col("a").alias("cause_id"), F.col("b").alias("effect_id"), S.rounded(F.col("w") / F.col("total")).alias("probability"))


@query("g14_spread_activation", ctes("associations") + ", e AS (SELECT a_id AS a, b_id AS b, strength FROM associations UNION ALL SELECT b_id, a_id, strength FROM associations), l0 AS (SELECT 5::BIGINT AS id, 0 AS depth, 1.0::DOUBLE AS x), l1 AS (SELECT b AS id, 1 AS depth, max(x * strength * (1 - 0.3)) AS x FROM l0 JOIN e ON l0.id = a WHERE x * strength * (1 - 0.3) >= 0.05 AND b NOT IN (SELECT id FROM l0) GROUP BY b), l2 AS (SELECT b AS id, 2 AS depth, max(x * strength * (1 - 0.3)) AS x FROM l1 JOIN e ON l1.id = a WHERE x * strength * (1 - 0.3) >= 0.05 AND b NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1) GROUP BY b) SELECT id, depth, round(x, 6) AS activation FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)")
def spread_activation(spark, sf):
    a = T.associations(spark, sf)
    e = a.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "strength").unionByName(a.select(F.col("b_id").alias("a"), F.col("a_id").alias("b"), "strength"))
    seeds = spark.createDataFrame([(5, 1.0)], "id long, activation double")
    return G.activation(e, seeds, 2, 0.3, 0.05).withColumn("activation", S.rounded("activation"))


#: What follows what in all agents' chains, repeats included, seen three times and more.
FOLLOWS = ", e AS (SELECT a, b FROM chains GROUP BY a, b HAVING sum(evidence_count) >= 3)"
#: For every edge the shortest way back, the smallest node first at each step from its start; closed paths graded by their length.
SHORTEST = """, r(seed, id, depth) AS (SELECT DISTINCT b, b, 0 FROM e UNION SELECT seed, b, depth + 1 FROM r JOIN e ON id = a WHERE depth < 30),
m AS (SELECT seed, id, min(depth) AS d FROM r GROUP BY 1, 2),
p AS (SELECT x.seed, x.id, min(a) AS before FROM m x JOIN e ON b = x.id JOIN m y ON y.seed = x.seed AND y.id = a AND y.d = x.d - 1 GROUP BY 1, 2),
w(seed, id, path) AS (SELECT b, a, [a] FROM e JOIN m ON seed = b AND id = a UNION ALL SELECT w.seed, before, list_prepend(before, path) FROM w JOIN p ON p.seed = w.seed AND p.id = w.id),
c AS (SELECT DISTINCT list_concat(path[list_position(path, list_min(path)):], path[1:list_position(path, list_min(path)) - 1]) AS path FROM w WHERE id = seed)
SELECT CAST(len(path) AS INT) AS length, array_to_string(path, '>') AS cycle, CASE WHEN len(path) + 1 <= 2 THEN 'CRITICAL' WHEN len(path) + 1 <= 4 THEN 'HIGH' WHEN len(path) + 1 <= 6 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c"""


@query("g16_cycles", ctes("chains", recursive=True) + FOLLOWS + SHORTEST)
def cycles(spark, sf):
    """A shortest cycle through every edge that lies on one, graded by its closed path: a node that leads to itself is critical."""
    e = T.chains(spark, sf).groupBy("a", "b").agg(F.sum("evidence_count").alias("n")).where("n >= 3")
    closed = F.col("length") + 1
    severity = F.when(closed <= 2, "CRITICAL").when(closed <= 4, "HIGH").when(closed <= 6, "MEDIUM").otherwise("LOW")
    return C.shortest_cycles(e).select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), severity.alias("severity"))


#: Edges (of e) that lie on a cycle, by the closure of all ways.
CLOSURE = ", r(s, t) AS (SELECT a, b FROM e UNION SELECT s, b FROM r JOIN e ON t = a)"


def _opposed_sql(x: str, y: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{a}') AND contains(lower({y}), '{b}') THEN '{kind}'" for a, b, kind in X.OPPOSITES) + " END"


@query("g17_chain_validation", ctes("chains", "entities", recursive=True) + f", e AS (SELECT agent_id * 1000 + a AS a, agent_id * 1000 + b AS b FROM chains){CLOSURE}, l AS (SELECT agent_id, s IS NOT NULL AS on_cycle, strength < 0.5 AS weak, {_opposed_sql('x.content', 'y.content')} AS opposed FROM chains c LEFT JOIN r ON s = agent_id * 1000 + c.b AND t = agent_id * 1000 + c.a LEFT JOIN entities x ON x.id = c.a LEFT JOIN entities y ON y.id = c.b) SELECT agent_id, count(*) AS links, count(*) FILTER (on_cycle) AS on_cycles, count(*) FILTER (weak) AS weak_links, count(opposed) AS contradictions, max(opposed) AS reason, NOT bool_or(on_cycle OR weak OR opposed IS NOT NULL) AS is_valid, CASE WHEN bool_or(on_cycle) THEN 'HIGH' WHEN bool_or(weak OR opposed IS NOT NULL) THEN 'MEDIUM' END AS severity FROM l GROUP BY agent_id")
def chain_validation(spark, sf):
    """Every agent's chain: links on cycles of any length, weak links, and links between statements that oppose each other."""
    c = T.chains(spark, sf)
    bounds = c.agg(F.min(F.least("a", "b")), F.max(F.greatest("a", "b"))).first()
    numbered = c.select("agent_id", (F.col("agent_id") * 1000 + F.col("a")).alias("a"), (F.col("agent_id") * 1000 + F.col("b")).alias("b"), F.col("a").alias("x"), F.col("b").alias("y"), "strength")
    if bounds[0] is None or 0 <= bounds[0] and bounds[1] < 1000:  # no node is two agents'
        links = C.marked_within(numbered, "agent_id")
    else:
        on = C.cyclic_edges(numbered).select("a", "b", F.lit(True).alias("on_cycle"))
        links = numbered.join(on, ["a", "b"], "left")
    said = T.entities(spark, sf).select("id", F.lower("content").alias("said"))
    words = {w for a, b, _ in X.OPPOSITES for w in (a, b)}
    said = said.select("id", *(F.contains("said", F.lit(w)).alias(w) for w in sorted(words)))  # texts don't move: their words do
    opposed = F.coalesce(*(F.when(F.col(f"p.{a}") & F.col(f"q.{b}"), kind) for a, b, kind in X.OPPOSITES))
    met = c.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()  # what two statements say is settled once, not once an agent
    met = met.join(said.alias("p"), F.col("p.id") == F.col("x"), "left").join(said.alias("q"), F.col("q.id") == F.col("y"), "left")
    links = links.join(met.select("x", "y", opposed.alias("reason")), ["x", "y"], "left")
    cycle, weak, reason = F.coalesce("on_cycle", F.lit(False)), F.col("strength") < 0.5, F.col("reason")
    g = links.groupBy("agent_id").agg(rows().alias("links"), F.count_if(cycle).alias("on_cycles"), F.count_if(weak).alias("weak_links"), F.count(reason).alias("contradictions"), F.max(reason).alias("reason"))
    valid = (F.col("on_cycles") == 0) & (F.col("weak_links") == 0) & (F.col("contradictions") == 0)
    return g.withColumns({"is_valid": valid, "severity": F.when(F.col("on_cycles") > 0, "HIGH").when(~valid, "MEDIUM")})


@query("g18_has_cycles", "WITH RECURSIVE e AS (SELECT c_custkey + 1000 AS a, CAST(c_nationkey + 100 AS BIGINT) AS b FROM customer UNION SELECT n_nationkey + 100, n_regionkey FROM nation)" + CLOSURE + " SELECT CAST(count(*) AS INT) AS edges_on_cycles FROM e JOIN r ON s = b AND t = a")
def has_cycles(spark, sf):
    """Customer to nation to region is a DAG: no edge lies on a cycle."""
    c = T.base(spark, sf, "customer").select((F.col("c_custkey") + 1000).alias("a"), (F.col("c_nationkey") + 100).cast("long").alias("b"))
    n = T.base(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    return C.cyclic_edges(c.unionByName(n)).agg(rows().cast("int").alias("edges_on_cycles"))


@query("g18_has_cycles_links", ctes("causal_links", recursive=True) + ", e AS (SELECT cause_id AS a, effect_id AS b FROM causal_links WHERE strength >= 0.6)" + CLOSURE + ", n AS (SELECT a AS id FROM e UNION SELECT b FROM e), k AS (SELECT x.s AS id, min(x.t) AS component FROM r x JOIN r y ON y.s = x.t AND y.t = x.s GROUP BY 1) SELECT component, count(*) AS nodes, (SELECT count(*) FROM e JOIN k i ON i.id = a JOIN k j ON j.id = b WHERE i.component = k.component AND j.component = k.component) AS edges_on_cycles FROM k GROUP BY component")
def has_cycles_links(spark, sf):
    """Strongly connected components of causal links: none where the model is a DAG."""
    e = C.cyclic_edges(_links(spark, sf, 0.6))
    return e.groupBy("component").agg(F.count_distinct("a").alias("nodes"), rows().alias("edges_on_cycles"))


@query("g20_provenance_chain", "SELECT o_orderkey, l_linenumber AS place, p_name AS source FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 100 = 0 AND l_linenumber <= 3".replace("o_orderkey % 100 = 0 AND ", ""))
def provenance_chain(spark, sf, most: int = 3):
    o, l, p = (T.base(spark, sf, t) for t in ("orders", "lineitem", "part"))
    j = l.where(F.col("l_linenumber") <= most).join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return j.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("source"))


@query("g21_graph_search", ctes("actions", "causal_links") + ", s AS (SELECT DISTINCT k AS id FROM actions WHERE action_type ILIKE '%purch%' AND success_score >= 0.99) SELECT s.id AS seed, c.effect_id AS neighbor, c.strength AS strength FROM s JOIN causal_links c ON c.cause_id = s.id WHERE c.strength >= 0.4")
def graph_search(spark, sf):
    s = T.actions(spark, sf).where(F.contains(F.lower("action_type"), F.lit("purch")) & (F.col("success_score") >= 0.99)).select(F.col("k").alias("a")).distinct()
    return s.join(_links(spark, sf, 0.4), "a").select(F.col("a").alias("seed"), F.col("b").alias("neighbor"), "strength")


@query("g22_neighbor_expansion", ctes("relations") + "SELECT from_id, relation_type, count(*) AS n, round(avg(strength), 6) AS strength FROM relations WHERE strength >= 0.4 GROUP BY 1, 2")
def neighbor_expansion(spark, sf):
    return T.relations(spark, sf).where("strength >= 0.4").groupBy("from_id", "relation_type").agg(rows().alias("n"), S.rounded(F.avg("strength")).alias("strength"))


@query("w11_causal_coverage", ctes("causal_links", "actions") + ", p AS (SELECT agent_id, k AS a, lead(k) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS b FROM actions) SELECT agent_id, round(avg(CASE WHEN strength IS NULL THEN 0.0 ELSE 1.0 END) * coalesce(avg(strength), 0), 6) AS confidence FROM p LEFT JOIN causal_links c ON c.cause_id = a AND c.effect_id = b AND c.strength >= 0.4 WHERE b IS NOT NULL GROUP BY agent_id")
def causal_coverage(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    p = T.actions(spark, sf).select("agent_id", F.col("k").alias("a"), F.lead("k").over(w).alias("b")).where("b IS NOT NULL")
    j = p.join(_links(spark, sf, 0.4).select("a", "b", "strength"), ["a", "b"], "left")
    return j.groupBy("agent_id").agg(S.rounded(F.avg(F.when(F.col("strength").isNull(), 0.0).otherwise(1.0)) * F.coalesce(F.avg("strength"), F.lit(0.0))).alias("confidence"))
