"""Components, shortest cycles and closing edges against plain searches, in tasks and as joins."""

import random
from collections import deque

import numpy as np
import pytest

from mnemospark.operators import cycles, graph
from mnemospark.operators.adjacency import Adjacency

#: Largest graph that is one task's work; below every graph, all is done by joins.
BOUNDS = [cycles.MAX_EDGES, -1]


def table(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, component string")


def distances(pairs, seed):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    out, queue = {seed: 0}, deque([seed])
    while queue:
        v = queue.popleft()
        for w in near.get(v, []):
            if w not in out:
                out[w] = out[v] + 1
                queue.append(w)
    return out


def on_cycles(pairs):
    """{edge: component}."""
    far = {v: distances(pairs, v) for v in {x for p in pairs for x in p}}
    return {(a, b): min(x for x in far if x in far[a] and a in far[x]) for a, b in pairs if a in far[b]}


def shortest(pairs):
    near, out = set(pairs), set()
    for a, b in near:
        far = distances(near, b)
        if a in far:
            way = [a]
            while way[-1] != b:
                way.append(min(x for x, y in near if y == way[-1] and far.get(x) == far[way[-1]] - 1))
            way = way[::-1]
            i = way.index(min(way))
            out.add(tuple(way[i:] + way[:i]))
    return out


def graphs():
    r = random.Random(11)
    ring = lambda n, at: [(at + i, at + (i + 1) % n) for i in range(n)]
    yield [(i, i + 1) for i in range(40)]  # a chain
    yield [*ring(9, 0), *[(8 - i, 50 + i) for i in range(3)], *[(70 + i, 71 + i) for i in range(7)], (77, 3), (50, 50)]
    yield [*ring(5, 0), *ring(4, 20), (0, 20), *ring(2, 40), (23, 40), (41, 60), (3, 1)]  # rings one after the other
    yield [*[(i, i // 2) for i in range(1, 40)], (0, 37), (5, 39)]  # a tree whose root leads to leaves
    yield [(a, b) for a in range(6) for b in range(6)]
    for n, m in ((12, 14), (20, 34), (16, 60), (40, 55)):
        yield [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("most", BOUNDS)
def test_components(spark, most):
    at, pairs = 0, []
    for g in graphs():  # side by side in one table
        pairs += [(a + at, b + at) for a, b in g]
        at += 100
    got = cycles.cyclic_edges(table(spark, pairs * 2), most).collect()
    assert {(r.a, r.b): r.component for r in got} == on_cycles(sorted(set(pairs))) and len(got) == len({(r.a, r.b) for r in got})


@pytest.mark.parametrize("seed", range(2))
def test_components_by_joins_on_dense_and_sparse_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice((15, 60))
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice((1.1, 1.6, 3))))]
    assert {(x.a, x.b): x.component for x in cycles.cyclic_edges(table(spark, pairs), 0).collect()} == on_cycles(sorted(set(pairs)))


@pytest.mark.parametrize("most", BOUNDS)
def test_shortest_cycles(spark, most):
    at, pairs = 0, []
    for g in graphs():
        pairs += [(a + at, b + at) for a, b in g]
        at += 100
    got = [(r.length, tuple(r.path)) for r in cycles.shortest_cycles(table(spark, pairs), most).collect()]
    assert sorted(p for _, p in got) == sorted(shortest(pairs)) and all(n == len(p) for n, p in got)
    assert {1, 2, 9} <= {n for n, _ in got}


@pytest.mark.parametrize("most, depth", [(BOUNDS[0], 1), (BOUNDS[0], 4), (BOUNDS[0], 10), (BOUNDS[1], 4)])
def test_closing(spark, most, depth):
    r = random.Random(depth)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(52)] + [(100 + i, 101 + i) for i in range(30)]
    wanted = [(r.randrange(42), r.randrange(42)) for _ in range(150)] + [(100 + r.randrange(31), 100 + r.randrange(31)) for _ in range(150)]
    far = {v: distances(pairs, v) for p in wanted for v in p}
    want = sorted((a, b, far[b].get(a, 99) <= depth) for a, b in wanted)
    assert len({x[2] for x in want}) == 2
    got = cycles.closing(table(spark, pairs), table(spark, wanted), depth, most)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("most", BOUNDS)
def test_reach(spark, most):
    pairs = [(random.Random(k).randrange(30), random.Random(1000 + k).randrange(30)) for k in range(1, 45)]
    seeds = [1, 1, 5, 17, 99]
    got = graph.reach(table(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "seed long"), 3, most).collect()
    assert sorted(map(tuple, got)) == sorted((s, v, d) for s in set(seeds) for v, d in distances(pairs, s).items() if d <= 3)


@pytest.mark.parametrize("most", BOUNDS)
def test_odd_rows(spark, most):
    none = spark.createDataFrame([], "a int, b int")
    assert cycles.cyclic_edges(none, most).count() == cycles.shortest_cycles(none, most).count() == cycles.closing(none, none, 3, most).count() == 0
    e = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (2, None), (3, 4), (None, None)], "a long, b long")
    assert [tuple(r) for r in cycles.cyclic_edges(e, most).collect()] == [(1, 1, 1)]
    assert [tuple(r) for r in cycles.shortest_cycles(e, most).collect()] == [(1, [1])]
    got = sorted(map(tuple, cycles.closing(e, e, 3, most).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 2, False), (2, None, False), (3, 4, False), (None, None, False)], key=str)


def test_a_chain_takes_few_rounds(spark):
    """3,000 nodes in a row: as many rounds of joins as that has binary digits."""
    pairs = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    c = cycles.Contraction(pairs)
    assert len(c.jumps) <= 13 and c.rest().count() == 0
    ring = spark.range(3000).selectExpr("id AS a", "(id + 1) % 3000 AS b")
    c = cycles.Contraction(ring)
    assert len(c.jumps) <= 13 and c.rest().count() == 0
    assert c.expand(spark.createDataFrame([], "id long, component long")).where("component = 0").count() == 3000


def test_deep_search_without_recursion():
    n = 100_000
    a = np.arange(n)
    assert (cycles.strong_components(Adjacency(a, (a + 1) % n)) == 0).all()
    assert (cycles.strong_components(Adjacency(a, a + 1)) == np.arange(n + 1)).all()


def test_pagerank_by_joins_equals_one_task(spark, tolerance=0.02):
    pairs = [(random.Random(k).randrange(40), random.Random(1000 + k).randrange(40)) for k in range(1, 90)]
    e = table(spark, pairs)
    one = {r.id: r.rank for r in graph.pagerank(e, tolerance=tolerance).collect()}
    joined = graph.pagerank(e, tolerance=tolerance, most=-1)
    got = {r.id: r.rank for r in joined.collect()}
    assert set(got) == set(one) and all(abs(got[i] - one[i]) < 1e-12 for i in one) and abs(sum(one.values()) - 1) < 1e-9
    assert graph.pagerank(e.limit(0), most=-1).count() == graph.pagerank(e.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagerank")]


def test_a_round_of_pagerank_moves_ranks_alone(spark, monkeypatch):
    """The bucketed edges meet the ranks where they lie: of the exchanges of a round, none reads the table of edges."""
    plans = []
    real = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.pagerank(table(spark, [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)]), rounds=2, most=-1).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for p in plans if "Bucketed: true" in p]
    assert len(rounds) == 2
    for p in rounds:
        scan = p[: p.index("Bucketed: true")].splitlines()
        indent = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, depth = [], indent(scan[-1])
        for line in reversed(scan[:-1]):
            if indent(line) < depth:
                above.append(line)
                depth = indent(line)
            if "Join" in line and above and "Join" in above[-1]:
                break
        assert not any("Exchange" in line for line in above[: next(i for i, line in enumerate(above) if "Join" in line)])


@pytest.mark.parametrize("chunk, most", [(1, 10**6), (7, 10**6), (50_000, 10**6), (50_000, 3)])
def test_graphs_of_keys_are_marked_in_one_pass(spark, monkeypatch, chunk, most):

    monkeypatch.setattr(cycles, "CHUNK_EDGES", chunk)
    r = random.Random(chunk)
    rows = [(k, k * 100 + r.randrange(9), k * 100 + r.randrange(9), r.random()) for k in range(30) for _ in range(r.randrange(1, 16))]
    df = spark.createDataFrame(rows + [(40, None, 4001, 0.5), (41, 4100, 4100, 0.5)], "k long, a long, b long, w double")
    out = {}
    for _, a, b, _ in rows:
        out.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    got = cycles.marked_within(df, "k", most)
    assert got.columns == ["k", "a", "b", "w", "on_cycle"]
    want = sorted((*x, reaches(x[2], x[1])) for x in rows)
    found = [tuple(x) for x in got.collect()]
    assert sorted(x for x in found if x[0] < 40) == want
    assert sorted(x for x in found if x[0] >= 40) == sorted([(40, None, 4001, 0.5, False), (41, 4100, 4100, 0.5, True)], key=lambda x: x[0])
