"""Graph operators over edge tables: frontier joins, PageRank, spreading activation, cycles, betweenness.

Edges are rows (a, b, ...). Loops over levels read an edge table again and
again, so it is staged first, with the columns that count, and every level is
written to the shared folder.

Edge cases, for all operators: an edge with a null end is left out; repeated
edges count once, but where their strengths differ (``chain``, ``activation``:
the strongest counts); a loop (a = b) leads to a node that is reached already,
and is no cycle of ``cycles``; a seed without edges is its own only node; an empty edge table gives no edge, no
path and no score; other columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import adjacency
from mnemospark.operators.adjacency import MAX_EDGES, longs
from mnemospark.sources.storage import dropped, new_path, staged

#: Sources whose paths betweenness follows at once in joins.
SOURCE_BLOCK = 1_000


def _ends(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b)."""
    return edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()


def _strongest(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b) with their largest strength."""
    return edges.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.max("strength").alias("strength"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges(a, b) as an undirected simple graph: each direction once, no loops."""
    e = edges.select("a", "b").where("a <> b")
    return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, most: int = MAX_EDGES) -> DataFrame:
    """(seed, id, depth): nodes within ``depth`` steps along edges(a, b), at their smallest depth.

    Graphs of up to ``most`` edges are searched by tasks, each from its own
    seeds. In larger ones the frontier is joined with the edges, reduced to one
    row a node and stripped of nodes seen before: work grows with edges touched,
    not walks.
    """
    seen = frontier = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).where("seed IS NOT NULL").distinct()
    if not depth:
        return seen
    near = staged(_ends(edges), "edges")
    if (graph := adjacency.broadcast(near, most)) is not None:
        return _reach_in_tasks(seen.select(F.col("seed").cast("long")), graph, depth)
    for d in range(1, depth + 1):
        step = frontier.select("seed", F.col("id").alias("a")).join(near, "a").select("seed", F.col("b").alias("id")).distinct()
        frontier = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(d))
        if d == depth:
            return seen.unionByName(frontier)
        frontier = staged(frontier, "frontier")
        seen = seen.unionByName(frontier)


def _reach_in_tasks(seeds: DataFrame, graph, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            seeds = batch.column(0).to_numpy()
            for seed, place in zip(seeds.tolist(), g.places(seeds).tolist()):
                levels = [np.array([seed])]
                for nodes, _ in g.levels(place) if place >= 0 else ():
                    levels.append(g.nodes[nodes])
                    if len(levels) > depth:
                        break
                size = [len(x) for x in levels]
                yield pa.RecordBatch.from_arrays([*longs(np.full(sum(size), seed), np.concatenate(levels)), pa.array(np.repeat(np.arange(len(size)), size), pa.int32())], names=["seed", "id", "depth"])

    return seeds.mapInArrow(run, "seed long, id long, depth int")


def chain(edges: DataFrame, seed: int, depth: int) -> DataFrame:
    """(id, depth, parent, strength) from one seed: first level wins, then the strongest edge, then the smallest parent."""
    near = staged(_strongest(edges), "edges")
    seen = frontier = edges.sparkSession.createDataFrame([(seed, 0, None, 1.0)], "id long, depth int, parent long, strength double")
    for d in range(1, depth + 1):
        best = F.max(F.struct("strength", (-F.col("a")).alias("p"))).alias("m")
        step = frontier.select(F.col("id").alias("a")).join(near, "a").groupBy(F.col("b").alias("id")).agg(best)
        step = step.join(seen.select("id"), "id", "left_anti")
        frontier = staged(step.select("id", F.lit(d).alias("depth"), (-F.col("m.p")).alias("parent"), F.col("m.strength").alias("strength")), "chain")
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """Simple paths of up to ``most`` edges between two nodes, as arrays of ids."""
    near = staged(_ends(edges.where("a <> b")), "edges")
    out = None
    walk = near.where(F.col("a") == start).select(F.array("a", "b").alias("path"))
    for _ in range(most):
        hit = walk.where(F.element_at("path", -1) == end)
        out = hit if out is None else out.unionByName(hit)
        go = walk.where(F.element_at("path", -1) != end).withColumn("a", F.element_at("path", -1))
        walk = go.join(near, "a").where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
    return out


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """(length, path): simple cycles of 2 to ``most`` nodes along edges(a, b), each once, from its smallest node."""
    e = staged(_ends(edges.where("a <> b")), "edges")
    out = None
    walk = e.where("a < b").select(F.array("a", "b").alias("path"))
    ends = e.select(F.col("b").alias("first"), F.col("a").alias("last"))
    for n in range(2, most + 1):
        hit = walk.withColumn("first", F.element_at("path", 1)).withColumn("last", F.element_at("path", -1)).join(ends, ["first", "last"]).select(F.lit(n).alias("length"), "path")
        out = hit if out is None else out.unionByName(hit)
        if n == most:
            return out
        go = walk.withColumn("a", F.element_at("path", -1)).join(e, "a").where((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b")))
        walk = staged(go.select(F.concat("path", F.array("b")).alias("path")), "walks")


def activation(edges: DataFrame, seeds: DataFrame, depth: int, decay: float, least: float) -> DataFrame:
    """(id, depth, activation): a' = a * strength * (1 - decay), kept from ``least`` on; the first level wins, then the largest."""
    near = staged(_strongest(edges).select(F.col("a").alias("id"), "b", "strength"), "edges")
    seen = frontier = seeds.select("id", F.lit(0).alias("depth"), "activation")
    for d in range(1, depth + 1):
        passed = F.col("activation") * F.col("strength") * (1 - decay)
        step = frontier.join(near, "id").select(F.col("b").alias("id"), passed.alias("activation")).where(F.col("activation") >= least)
        step = step.groupBy("id").agg(F.max("activation").alias("activation")).join(seen.select("id"), "id", "left_anti")
        frontier = staged(step.select("id", F.lit(d).alias("depth"), "activation"), "activation")
        seen = seen.unionByName(frontier)
    return seen


def spread(edges: DataFrame, seeds: DataFrame, depth: int, decay: float, least: float) -> DataFrame:
    """(id, activation): what seeds(seed, id, activation) spread along edges(a, b, strength), added up and capped at 1.

    Each seed spreads by itself, over fewer than ``depth`` steps: a node takes
    the largest activation of the first level that reaches it, and hands on
    activation * strength * (1 - decay) where that is ``least`` and more. A seed
    that is given twice (under two numbers) counts twice.
    """
    near = staged(_strongest(edges), "edges")
    seen = level = seeds.where("seed IS NOT NULL AND id IS NOT NULL").groupBy("seed", "id").agg(F.max("activation").alias("activation"))
    for _ in range(depth - 1):
        passed = F.col("activation") * F.col("strength") * (1 - decay)
        step = level.where(F.col("activation") >= least).withColumnRenamed("id", "a").join(near, "a").select("seed", F.col("b").alias("id"), passed.alias("activation"))
        step = step.where(F.col("activation") >= least).groupBy("seed", "id").agg(F.max("activation").alias("activation"))
        level = staged(step.join(seen, ["seed", "id"], "left_anti"), "spread")
        seen = seen.unionByName(level)
    return seen.groupBy("id").agg(F.least(F.lit(1.0), F.sum("activation")).alias("activation"))


def chain_back(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, place, id): from each starts(id) back along links(id, previous), ``depth`` rows with the start (place 0) at most.

    Tables of the ancestors 1, 2, 4 and so on steps back are made by joining
    each with itself, so that the rounds are the binary digits of ``depth``. A
    chain ends where the previous id is null or no row of links (a broken link);
    one that runs into a cycle goes round it until ``depth``; of several links
    of one id the one to the largest previous id counts; a start without a row
    has no chain.
    """
    own = staged(links.where("id IS NOT NULL").groupBy("id").agg(F.max("previous").alias("to")), "links")
    up = own.where("to IS NOT NULL").join(own.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to")
    have = starts.select("id").distinct().join(own, "id", "left_semi").select(F.col("id").alias("start"), F.lit(0).alias("place"), "id")
    span = 1
    while span < depth:
        up = staged(up, "up")
        far = have.join(up, "id").select("start", (F.col("place") + span).alias("place"), F.col("to").alias("id"))
        have = have.unionByName(far.where(F.col("place") < depth))
        up = up.join(up.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to"))
        span *= 2
    return have


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, most: int = MAX_EDGES) -> DataFrame:
    """(id, rank) on an undirected simple graph (no dangling nodes), until a round changes the ranks by less than ``tolerance`` in all.

    Graphs of up to ``most`` directed edges are one task's work. Of larger ones
    the edges are written once, bucketed by their start with the node's degree,
    so that a round moves ranks and nothing else: they meet the edges where
    these lie, and only the sums for their ends are shuffled.
    """
    spark = edges.sparkSession
    both = staged(both_ways(edges), "pagerank")
    if (graph := adjacency.broadcast(both, most)) is not None:
        return _pagerank_in_a_task(both, graph, rounds, damping, tolerance)
    degree = staged(both.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), "degrees")
    n = degree.count()
    rank = degree.select(F.col("a").alias("id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    if not n:
        return rank
    name, parts = f"pagerank_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    both.join(degree, "a").repartition(parts, "a").write.option("path", new_path(spark, "pagerank")).bucketBy(parts, "a").saveAsTable(name)
    try:
        linked = spark.table(name)
        for _ in range(rounds):
            given = linked.join(rank.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("s"))
            new = given.join(rank, "id").select("id", (F.lit((1 - damping) / n) + F.col("s") * damping).alias("rank"), F.abs(F.lit((1 - damping) / n) + F.col("s") * damping - F.col("rank")).alias("moved"))
            after = staged(new, "pagerank")
            moved = after.agg(F.sum("moved")).first()[0]
            if hasattr(rank, "_staged_at"):
                dropped(rank)
            rank = after.select("id", "rank")
            rank._staged_at = after._staged_at
            if moved < tolerance:
                break
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return rank


def _pagerank_in_a_task(both: DataFrame, graph, rounds: int, damping: float, tolerance: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        g = graph.value
        n = len(g.nodes)
        degree = np.diff(g.start)
        rank = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds if n else 0):
            new = (1 - damping) / n + damping * np.bincount(g.heads, np.repeat(rank / degree, degree), n)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < tolerance:
                break
        yield pa.RecordBatch.from_arrays([*longs(g.nodes), pa.array(rank)], names=["id", "rank"])

    return both.sparkSession.range(1).repartition(1).mapInArrow(run, "id long, rank double")


def betweenness(edges: DataFrame, sources: DataFrame, most: int = MAX_EDGES, block: int = SOURCE_BLOCK) -> DataFrame:
    """(id, score) of the nodes that a shortest path of the undirected simple graph begins at, ends at or passes: Brandes from every source(id).

    Up to ``most`` directed edges the adjacency is broadcast and every task
    follows its sources; larger graphs are joined level by level, ``block``
    sources at once.
    """
    spark = edges.sparkSession
    both = staged(both_ways(edges), "betweenness")
    n = both.select("a").distinct().count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    seeds = sources.select("id").distinct().join(both.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    if both.count() > most:
        return _betweenness_joined(both, seeds, block).select("id", (F.col("score") * scale).alias("score"))
    near: dict[int, list[int]] = {}
    for r in both.toLocalIterator():
        near.setdefault(r.a, []).append(r.b)
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        total: dict[int, float] = {}
        for batch in batches:
            for s in batch.column(0).to_pylist():
                order, before, paths_, dist = [], {s: []}, {s: 1.0}, {s: 0}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in g.get(v, []):
                        if w not in dist:
                            dist[w], paths_[w], before[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths_[w] += paths_[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths_[v] / paths_[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(total), pa.int64()), "score": pa.array(list(total.values()), pa.float64())})

    return seeds.mapInArrow(run, "id long, score double").groupBy("id").agg((F.sum("score") * scale).alias("score"))


def _betweenness_joined(both: DataFrame, seeds: DataFrame, block: int) -> DataFrame:
    """Brandes as joins: levels of (source, node, paths) forwards, shares backwards."""
    n = seeds.count()
    dealt = staged(seeds.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(-(-n // block) or 1))), "sources")
    total = None
    for part in range(-(-n // block)):
        seen = dealt.where(F.col("part") == part).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"))
        levels = [staged(seen, "level")]
        while True:
            step = levels[-1].withColumnRenamed("id", "a").join(both, "a").groupBy("s", F.col("b").alias("id")).agg(F.sum("paths").alias("paths"))
            for old in levels[-2:]:  # a neighbour lies one level up, down or beside
                step = step.join(old.select("s", "id"), ["s", "id"], "left_anti")
            level = staged(step, "level")
            if level.isEmpty():
                break
            levels.append(level)
        share = levels[-1].select("s", "id", "paths", F.lit(0.0).alias("share"))
        for above in reversed(levels[:-1]):
            own = share.where("s <> id").select("id", "share")
            total = own if total is None else total.unionByName(own)
            passed = share.select("s", F.col("id").alias("a"), ((1 + F.col("share")) / F.col("paths")).alias("x")).join(both, "a")
            gained = above.join(passed.select("s", F.col("b").alias("id"), "x"), ["s", "id"], "left").groupBy("s", "id", "paths").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
            share = staged(gained.select("s", "id", "paths", (F.col("paths") * F.col("x")).alias("share")), "share")
        if total is not None:
            total = staged(total.groupBy("id").agg(F.sum("share").alias("share")), "betweenness")
        for old in levels:
            dropped(old)
    if total is None:
        return seeds.select("id", F.lit(0.0).alias("score")).limit(0)
    return total.groupBy("id").agg(F.sum("share").alias("score"))
