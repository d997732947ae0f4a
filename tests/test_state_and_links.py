"""Chains of links, spreading from several seeds, edit logs, upserts, scans and prototypes: against plain Python."""

import random

import numpy as np
import pytest

from mnemospark.operators import graph, learning, topk, vectors


@pytest.mark.parametrize("depth", [1, 2, 5, 8, 9])
def test_chains_end_at_broken_links_and_go_round_cycles(spark, depth):
    r = random.Random(depth)
    links = {i: (None if i % 11 == 0 else r.randrange(70)) for i in range(60)}  # 60 to 69 have no row
    links |= {100: 101, 101: 102, 102: 100, 200: 200}
    rows = [*links.items(), (3, None), (None, 4)]
    got = graph.chain_back(spark.createDataFrame(rows, "id long, previous long"), spark.createDataFrame([(i,) for i in [*links, 5, 65, None]], "id long"), depth).collect()
    want = set()
    for start in links:
        at, place = start, 0
        while place < depth and at in links:
            want.add((start, place, at))
            at, place = links[at], place + 1
    assert {(x.start, x.place, x.id) for x in got} == want and len(got) == len(want)


def test_seeds_spread_by_themselves(spark):
    r = random.Random(9)
    edges = [(r.randrange(14), r.randrange(14), r.choice([0.2, 0.5, 0.9, 1.0])) for _ in range(45)]
    seeds = [(0, 3, 0.4), (1, 3, 0.4), (2, 7, 0.9), (3, 99, 0.1)]
    total = {}
    for _, seed, x in seeds:
        seen = level = {seed: x}
        for _ in range(3):
            step = {}
            for a, b, s in edges:
                if a in level and level[a] >= 0.15 and level[a] * s * 0.7 >= 0.15 and b not in seen:
                    step[b] = max(step.get(b, 0), level[a] * s * 0.7)
            seen, level = seen | step, step
        for k, v in seen.items():
            total[k] = min(1.0, total.get(k, 0) + v)
    e = spark.createDataFrame([*edges, (None, 3, 1.0), (3, None, 1.0)], "a long, b long, strength double")
    got = graph.spread(e, spark.createDataFrame(seeds, "seed long, id long, activation double"), 4, 0.3, 0.15).collect()
    assert {x.id for x in got} == set(total) and all(abs(x.activation - total[x.id]) < 1e-9 for x in got)
    assert graph.spread(e, spark.createDataFrame([], "seed long, id long, activation double"), 4, 0.3, 0.15).count() == 0


def test_edit_logs(spark):
    rows = [("a", 1, "begin", False), ("a", 2, "more", False), ("a", 3, "x" * 50, False), ("a", 4, "end", False), ("b", 1, "y" * 99, False), ("b", 2, "z", False), ("c", 1, "fixed", True), ("c", 2, "no", True), ("d", 1, None, False), (None, 1, "n", None)]
    got = {r.k: (r.block, r.applied, r.refused) for r in learning.appended(spark.createDataFrame(rows, "k string, i int, t string, ro boolean"), "k", ["i"], "t", "ro", 20).collect()}
    assert got == {"a": ("begin\nmore\nend", 2, 1), "b": ("y" * 99, 0, 1), "c": ("fixed", 0, 1), None: ("n", 0, 0)}


def test_upserts_of_a_batch_with_repeats(spark):
    old = spark.createDataFrame([("p", "t", 4, 2, 3), ("q", "t", 0, 1, 0)], "name string, entity_type string, access_count long, current_version long, observations long")
    given = spark.createDataFrame([("p", "u", 2, 1), ("p", "v", 1, 1), ("n", "w", 5, 2), ("n", "x", 6, 0), (None, "y", 7, 9)], "name string, entity_type string, at int, observations int")
    got = {r.name: tuple(r)[1:] for r in topk.upserted(old, given).collect()}
    assert got == {"p": ("u", 6, 4, 5, "update"), "q": ("t", 0, 1, 0, "keep"), "n": ("x", 1, 2, 2, "insert")}
    assert topk.upserted(old.limit(0), given.limit(0)).count() == 0


def test_a_scan_gives_a_row_for_each(spark):
    rows = [(k, i, float((k * 7 + i * 3) % 10)) for k in range(5) for i in range(40)] + [(9, 1, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(3)
    got = learning.scanned(df, "k", ["i"], "x", lambda: 0.0, lambda s, x: (s + x, (s + x, x > 4)), "total double, large boolean").collect()
    want, total = {}, {}
    for k, i, x in sorted((r for r in rows if r[2] is not None), key=str):
        pass
    for k, i, x in [r for r in rows if r[2] is not None]:
        total[k] = total.get(k, 0.0) + x
        want[k, i] = (total[k], x > 4)
    assert {(r.k, r.i): (r.total, r.large) for r in got} == want


def test_memories_beyond_the_gate_are_forgotten(spark):
    import datetime

    begin = datetime.datetime(2024, 1, 1)
    rows = [(k, i, f"memory {k} {i} " + "word " * i, begin + datetime.timedelta(hours=i), 0.9) for k in range(6) for i in range(30)]
    m = spark.createDataFrame(rows, "k long, id long, text string, at timestamp_ntz, salience double")
    every = learning.consolidated_memories(m, "k", 24, 10**6).collect()
    assert {(r.k, r.id) for r in every} == {(k, i) for k in range(6) for i in range(6, 30)}  # the last day
    promoted = [r for r in every if r.verdict == "promoted"]
    gated = learning.consolidated_memories(m, "k", 24, len(promoted) - 7).collect()
    gone = {(r.k, r.id) for r in gated if r.verdict == "forgotten"}
    assert len(gone) == 7 and max(r.score for r in gated if r.verdict == "forgotten") <= max(r.score for r in promoted)
    assert learning.consolidated_memories(m.limit(0), "k", 24, 5).count() == 0


def test_followers_and_thresholds_of_surprise():
    state = (0.5, 0, learning.STORE, [])
    state, found = learning.promote_step(state, 0.9)
    assert found == (1.0, True) and state[1] == learning.FOLLOWERS
    state, found = learning.promote_step(state, 0.1)
    assert found[1] and state[1] == learning.FOLLOWERS - 1  # a low score that follows a high one
    for _ in range(2):
        state, _ = learning.promote_step(state, 0.1)
    assert not learning.promote_step(state, 0.1)[1][1]
    for _ in range(30):
        state, _ = learning.promote_step(state, 0.95)
    assert state[2] == 0.7  # many surprises: more selective


def test_prototypes_equal_plain_rounds(spark):
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.standard_normal((40, 5)) * 0.2 + c for c in (np.eye(5)[0] * 3, np.eye(5)[1] * 3, np.eye(5)[2] * 3)])
    m = m[rng.permutation(120)]
    df = spark.createDataFrame([(i, [float(x) for x in v], (i % 10) / 10) for i, v in enumerate(m)], "id long, v array<double>, quality double")
    p = vectors.Prototypes(df.unionByName(spark.createDataFrame([(900, None, 1.0), (None, [1.0] * 5, 1.0), (901, [1.0], 1.0)], df.schema)), 4, rounds=3)
    c = m[:4].copy()
    for _ in range(3):
        near = ((m[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([m[near == j].mean(0) if (near == j).any() else c[j] for j in range(4)])
    assert np.allclose(p.centres, c)
    near = ((m[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert {r.id: r.cluster for r in p.assigned().collect()} == dict(enumerate(near.tolist()))
    got = {r.cluster: (r.n, r.avg_quality) for r in p.patterns("quality", 20, 0.4).collect()}
    assert set(got) == {j for j in range(4) if (near == j).sum() >= 20 and np.mean([(i % 10) / 10 for i in np.flatnonzero(near == j)]) >= 0.4}
    raised = p.boosted(df.selectExpr("id", "v", "0.5 AS score"), [0, 1], 1.25, 0.9).collect()
    assert {r.score for r in raised} == {0.5, 0.625} and all((r.match >= 0.9) == (r.score > 0.5) for r in raised)
    none = vectors.Prototypes(df.limit(0), 4)
    assert none.patterns("quality").count() == 0
