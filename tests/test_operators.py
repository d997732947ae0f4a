"""Operators without SQL, against brute force in Python."""

import math
import random

import numpy as np

from mnemospark.operators import analytics, chunking, cycles, graph, learning, vectors
from mnemospark.operators import filters, topk
from mnemospark.sources import storage, tables
from mnemospark.streaming import jobs

SF = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, s) for a, b, s in pairs], "a long, b long, strength double")


def random_edges(seed, n=30, m=70):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), round(r.random(), 3)) for _ in range(m)]


def test_reach_is_breadth_first(spark):
    pairs = random_edges(1)
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
    want, frontier = {3: 0}, {3}
    for d in (1, 2, 3):
        frontier = {b for a in frontier for b in near.get(a, ())} - set(want)
        want |= dict.fromkeys(frontier, d)
    got = graph.reach(edges(spark, pairs), spark.createDataFrame([(3,)], "seed long"), 3)
    assert {r.id: r.depth for r in got.collect()} == want


def test_reach_from_unknown_seed_and_no_edges(spark):
    got = graph.reach(edges(spark, []), spark.createDataFrame([(9,)], "seed long"), 2)
    assert [(r.id, r.depth) for r in got.collect()] == [(9, 0)]


def test_betweenness_equals_path_counting(spark):
    pairs = [(a, b, s) for a, b, s in random_edges(2, 12, 20) if a != b]
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, x] for p in level for x in near[p[-1]] if x not in p]
        return found

    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t in near:
            if s != t and (ps := shortest(s, t)):
                for p in ps:
                    for v in p[1:-1]:
                        want[v] += 1 / len(ps)
    n = len(near)
    e = edges(spark, pairs)
    got = graph.betweenness(e, graph.both_ways(e).selectExpr("a AS id").distinct())
    for r in got.collect():
        assert math.isclose(r.score, want[r.id] / ((n - 1) * (n - 2)), abs_tol=1e-9)
    for block in (1000, 4):  # level by level, in joins
        joined = {r.id: r.score for r in graph.betweenness(e, graph.both_ways(e).selectExpr("a AS id").distinct(), 0, block).collect()}
        assert set(joined) == set(want) and all(math.isclose(x, want[i] / ((n - 1) * (n - 2)), abs_tol=1e-9) for i, x in joined.items())


def test_pagerank_sums_to_one_and_ranks_the_hub(spark):
    e = edges(spark, [(0, i, 1.0) for i in range(1, 8)])
    got = {r.id: r.rank for r in graph.pagerank(e, 12).collect()}
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9) and max(got, key=got.get) == 0


def test_edges_on_cycles(spark):
    assert cycles.cyclic_edges(edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)])).count() == 0
    left = cycles.cyclic_edges(edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0)]))
    assert {(r.a, r.b) for r in left.collect()} == {(2, 3), (3, 2)}


def test_chain_takes_the_strongest_parent(spark):
    got = {r.id: (r.depth, r.parent) for r in graph.chain(edges(spark, [(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.8), (3, 4, 0.8), (4, 1, 1.0)]), 1, 3).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2)}


def test_knn_equals_numpy(spark):
    v = tables.vectors(spark, SF)
    rows = v.collect()
    m = np.array([r.v for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r.id for r in rows])
    got = {}
    for r in vectors.knn(v, v.where("id % 20 = 0"), 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        want = [int(ids[i]) for i in np.lexsort((ids, -s))[:5]]
        assert [i for _, i in sorted(got[int(q)])] == want


def test_knn_without_queries(spark):
    v = tables.vectors(spark, SF)
    assert vectors.knn(v, v.limit(0), 3).count() == 0
    assert vectors.knn(v.limit(0), v, 3).count() == 0


def test_knn_by_blocks_and_odd_rows(spark):
    """Every row against all, in blocks of both sides; ties, zero, null and ragged vectors."""
    r = random.Random(8)
    rows = [(i, [round(r.uniform(-1, 1), 1) for _ in range(3)]) for i in range(90)]
    rows += [(100, [0.0, 0.0, 0.0]), (101, None), (102, []), (None, [1.0, 0.0, 0.0]), (103, [1.0, None, 0.0]), (104, [1.0, 0.0]), (105, [0.5, 0.5]), (106, rows[3][1]), (107, rows[3][1])]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "id long, v array<double>, score double")
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v]
    unit = {i: v / n if (n := np.linalg.norm(v)) else v for i, v in good}
    want = {}
    for i, x in unit.items():
        near = sorted((-float(np.round(x @ y, 12)), j) for j, y in unit.items() if i != j and len(x) == len(y))
        want[i] = [(round(-s, 9), j) for s, j in near[:4]]
    for blocks in ((1024, 262_144), (20, 17)):
        got = {}
        for x in vectors.knn(df, df, 4, query_block=blocks[0], vector_block=blocks[1]).orderBy("query", "rank").collect():
            got.setdefault(x["query"], []).append((round(x["score"], 9) + 0.0, x["id"]))
        for i, near in want.items():
            assert sorted(s for s, _ in got.get(i, [])) == sorted(s for s, _ in near)
            assert {j for s, j in got.get(i, []) if s > near[-1][0]} == {j for s, j in near if s > near[-1][0]}


def test_index_reaches_its_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    m = centres[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(4)
    index = vectors.VectorIndex(df, lists=24, sample=400)
    assert index.listed.count() == 1500
    q = df.where("id % 20 = 0")
    probes, recall = index.probes_for(q, 5, 0.9)
    assert recall >= 0.9 and probes < 24
    exact = {tuple(x) for x in vectors.knn(df, q, 5).select("query", "id").collect()}
    assert len(exact & {tuple(x) for x in index.search(q, 5, probes).select("query", "id").collect()}) / len(exact) == recall
    assert {tuple(x) for x in index.search(q, 5, 24).select("query", "id").collect()} == exact  # all lists: exact
    hard = tables.vectors(spark, SF)  # vectors without any structure
    assert vectors.VectorIndex(hard).probes_for(hard.where("id % 20 = 0"), 5, 0.9)[1] >= 0.9
    assert vectors.VectorIndex(hard.limit(0)).search(hard, 3, 1).count() == 0


def test_vector_operators_take_odd_rows(spark):
    rows = [(1, 1, [1.0, 0.0], 0.9), (2, 1, [0.9, 0.1], 0.8), (3, None, [0.0, 1.0], 0.7), (4, 2, None, 0.6), (5, 2, [1.0], 0.5), (None, 2, [1.0, 1.0], 0.4), (6, 2, [0.0, 0.0], None), (7, 1, [1.0, None], 0.3), (7, 1, [0.5, 0.5], 0.3)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>, score double")
    none = df.limit(0)
    assert {r.id for r in vectors.diverse(df.where("size(v) = 2"), 9).collect()} == {1, 2, 3, 7}
    assert vectors.diverse(none, 3).count() == vectors.kmeans(none, 2).count() == vectors.art_categories(none, "label").count() == 0
    assert {r.id for r in vectors.kmeans(df, 2).collect()} == {1, 2, 3, 6, 7}
    assert {(r.id, r.label) for r in vectors.art_categories(df, "label").collect()} == {(1, 1), (2, 1), (3, None), (6, 2), (7, 1)}
    assert {r.id for r in vectors.fused({"a": spark.createDataFrame([(1, 1), (None, 2), (2, None)], "id long, rank int"), "b": spark.createDataFrame([], "id long, rank int")}, 5).collect()} == {1}
    assert vectors.consolidated(df, 0.9).count() == 1


def test_art_equals_a_plain_loop(spark):
    """Choice, vigilance, update and eviction in lists of numbers."""
    r = random.Random(3)
    rows = [(i, i % 2, [r.random() for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>").repartition(5)
    for vigilance, most in ((0.7, 100), (0.85, 100), (0.9, 5)):
        want = {}
        for label in (0, 1):
            prototypes, used = [], []
            for i, _, v in (x for x in rows if x[1] == label):
                low, high = min(v), max(v)
                x = [(a - low) / (high - low) for a in v]
                x += [1 - a for a in x]
                best = sorted(range(len(prototypes)), key=lambda j: (-sum(map(min, x, prototypes[j])) / (0.001 + sum(prototypes[j])), j))
                j = next((j for j in best if sum(map(min, x, prototypes[j])) / sum(x) >= vigilance), None)
                if j is not None:
                    prototypes[j] = [0.5 * min(a, b) + 0.5 * b for a, b in zip(x, prototypes[j])]
                    used[j] += 1
                elif len(prototypes) < most:
                    j = len(prototypes)
                    prototypes.append(x)
                    used.append(1)
                else:
                    j = min(range(most), key=lambda k: (used[k], k))
                    prototypes[j], used[j] = x, 1
                want[i] = j
        got = {x.id: x.category for x in vectors.art_categories(df, "label", vigilance=vigilance, most=most).collect()}
        assert got == want and len(set(want.values())) > 1


def test_kmeans_ends_where_means_and_members_agree(spark):
    v = tables.vectors(spark, SF)
    rows = {r.id: np.array(r.v) for r in v.collect()}
    member = {r.id: r.cluster for r in vectors.kmeans(v, 5, seed=7).collect()}
    assert set(member) == set(rows)
    mean = {c: np.mean([rows[i] for i in rows if member[i] == c], axis=0) for c in set(member.values())}
    off = sum(min(mean, key=lambda c: ((rows[i] - mean[c]) ** 2).sum()) != member[i] for i in rows)
    assert len(mean) == 5 and off <= 0.02 * len(rows)


def test_art_learns_one_category_for_equal_vectors():
    art = vectors.FuzzyART(vigilance=0.9, most=2)
    assert [art.learn(np.array([0.1, 0.9])) for _ in range(3)] == [0, 0, 0]
    assert art.learn(np.array([0.9, 0.1])) == 1
    assert art.learn(np.array([0.5, 0.0])) == 1  # the fuller memory keeps its most used category


def test_diverse_prefers_a_different_vector(spark):
    c = spark.createDataFrame([(1, 1.0, [1.0, 0.0]), (2, 0.99, [1.0, 0.01]), (3, 0.8, [0.0, 1.0])], "id long, score double, v array<double>")
    assert [r.id for r in vectors.diverse(c, 2).orderBy("place").collect()] == [1, 3]


def test_folds_are_ordered(spark):
    df = spark.createDataFrame([(1, 2, 0.0), (1, 1, 1.0), (2, 1, 0.25), (2, 2, None), (3, 1, None), (None, 1, 0.5)], "k long, t long, success_score double")
    got = {r.k: r.affinity for r in learning.affinity(df, "k", ["t"]).collect()}
    assert got == {1: 0.7, 2: 0.25, None: 0.5}
    for fold in (learning.surprise, learning.q_values, learning.fisher):
        assert {r.k for r in fold(df, "k", ["t"]).collect()} == {1, 2, None}
    assert learning.surprise_step((3, 0.5, 0.4, 1), None) == (3, 0.5, 0.4, 1)
    one = learning.online_sgd(df.selectExpr("*", "CAST(NULL AS double) AS f"), "k", ["t"], {"f": 0.2})
    assert {(r.k, r.n, r.w_f) for r in one.collect()} == {(1, 2, 0.2), (2, 1, 0.2), (None, 1, 0.2)}
    assert learning.q_values(df.limit(0), "k", ["t"]).count() == 0


def test_chunks_overlap_and_cover():
    text = "One two. Three four. Five six. Seven."
    got = chunking.pack(chunking.split(text), 22, 1)
    assert got == [["One two.", "Three four."], ["Three four.", "Five six."], ["Five six.", "Seven."]]
    assert chunking.pack([], 10, 1) == [] and chunking.split(None) == []
    assert len(chunking.summary(text * 20, 60)) <= 60


def test_literal_search_and_membership(spark):
    df = spark.createDataFrame([(1, "100%", []), (2, "100x", ["a"]), (3, None, None)], "id long, t string, who array<string>")
    assert [r.id for r in df.where(filters.contains_text("t", "100%")).collect()] == [1]
    assert {r.id for r in filters.meant_for(df, "a", "who").collect()} == {1, 2, 3}
    assert {r.id for r in filters.meant_for(df, "b", "who").collect()} == {1, 3}


def test_first_frame_wins(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "id long, name string")
    assert {(r.id, r.name) for r in topk.combine([a, b], "name").collect()} == {(1, "x"), (3, "y")}


def test_valid_at_half_open(spark):
    import datetime as d

    t = d.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, t, None), (2, t, t), (3, d.datetime(2024, 1, 1), t)], "id long, valid_from timestamp_ntz, valid_until timestamp_ntz")
    assert [r.id for r in filters.valid_at(df, t).collect()] == [1]


def test_files_round_trip(spark, tmp_path):
    e = tables.entities(spark, SF).select("id", "name", "content", "created_at")
    storage.export_agent(e, f"file://{tmp_path}/agent", most=5)
    back = storage.import_agent(spark, f"file://{tmp_path}/agent", "id long, name string, content string", e.orderBy("id").limit(e.count() - 2).select("name"))
    assert {r.status: r["count"] for r in back.groupBy("status").count().collect()} == {"imported": 2, "skipped": 3}
    storage.append_json_lines(spark.range(3), f"file://{tmp_path}/log")
    storage.append_json_lines(spark.range(2), f"file://{tmp_path}/log")
    assert storage.read_json_lines(spark, f"file://{tmp_path}/log", "id long").count() == 5
    (tmp_path / "t").mkdir()
    (tmp_path / "t/Notes.txt").write_text("é")
    (tmp_path / "t/x.bin").write_text("no")
    files = storage.read_text_files(spark, f"file://{tmp_path}/t")
    assert [r.content for r in files.collect()] == ["é"]
    assert storage.find_files(spark, f"file://{tmp_path}/t", "notes").count() == 1
    assert storage.changed_files(files, files.select("path", "sha256")).count() == 0


def test_migrations_are_applied_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, 2), (None, 3)], "id long, x int").write.parquet(f"{path}/v0")
    one, two = ("y", {"y": "x + 1"}), ("x", {"x": "x * 10", "z": "'new'"})
    assert {tuple(r) for r in storage.migrate(spark, path, [one]).collect()} == {(1, 2, 3), (None, 3, 4)}
    for _ in range(2):
        assert {tuple(r) for r in storage.migrate(spark, path, [one, two]).collect()} == {(1, 20, 3, "new"), (None, 30, 4, "new")}
    assert len(list(tmp_path.glob("t/v*"))) == 3


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as d

    def put(name, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/events/{name}")

    day = d.datetime(2024, 1, 10)
    put("1", [(1, day, 1, "view", 10.0), (2, day + d.timedelta(days=3), 1, "view", 20.0)])
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/events").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "event_type", "value")
    out = jobs.run_once(jobs.tumbling(s), "append")
    assert [(r.n, r.mean) for r in out.collect()] == [(1, 0.1)]  # the newest window is still open


def test_first_of_each_user_and_type(spark):
    e = jobs.event_stream(spark, f"{SF}/events.parquet")
    out = jobs.run_once(jobs.live_memory(e, 2400), "append")
    want = tables.base(spark, SF, "events").select("user_id", "event_type").distinct().count()
    assert out.count() == want


def test_located_chunks_are_slices(spark):
    text = "One two. Three four. Five six. Seven eight nine ten eleven. A. B."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = [(r.id, text[r.start : r.end]) for r in chunking.located(rows, 22, 2).orderBy("id", "chunk").collect()]
    assert {i for i, _ in got} == {1} and [t for _, t in got] == [" ".join(c) for c in chunking.pack(chunking.split(text), 22, 2)]
    assert chunking.semantic(rows, 40, 0.1).where("id = 1").count() >= 2


def test_streamed_surprise_equals_the_batch_fold(spark):
    a = tables.actions(spark, SF)
    batch = {tuple(r) for r in learning.surprise(a, "agent_id", ["executed_at", "action_id"]).collect()}
    out = jobs.run_once(jobs.running_surprise(jobs.event_stream(spark, f"{SF}/events.parquet")), "update", ["user_id"])
    assert {tuple(r) for r in out.collect()} == batch


def test_updates_of_several_batches_are_merged(spark, tmp_path):
    """The same events in three files: no user is lost, and each has the state after its last event."""
    events = tables.base(spark, SF, "events")
    cuts = events.approxQuantile("event_id", [0.34, 0.67], 0.0)
    for i, where in enumerate((f"event_id < {cuts[0]}", f"event_id >= {cuts[0]} AND event_id < {cuts[1]}", f"event_id >= {cuts[1]}")):
        events.where(where).coalesce(1).write.parquet(f"file://{tmp_path}/{i}")
    import os
    import shutil
    import time

    os.mkdir(tmp_path / "in")
    for i in range(3):
        for f in (tmp_path / str(i)).glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    stream = jobs.event_stream(spark, f"file://{tmp_path}/in", 1)
    got = {r.user_id: (r.n, r.momentum) for r in jobs.run_once(jobs.running_surprise(stream), "update", ["user_id"]).collect()}
    scored = events.selectExpr("user_id", "event_id", "ts", "least(1.0, value / 100.0) AS success_score", f"CASE WHEN event_id < {cuts[0]} THEN 0 WHEN event_id < {cuts[1]} THEN 1 ELSE 2 END AS file")
    want = {r.user_id: (r.n, r.momentum) for r in learning.surprise(scored, "user_id", ["file", "ts", "event_id"]).collect()}
    assert got == want and len(got) == events.select("user_id").distinct().count()
    tiers = jobs.run_once(jobs.running_tiers(jobs.event_stream(spark, f"file://{tmp_path}/in", 1)), "update", ["event_type", "tier"])
    assert {tuple(r) for r in tiers.selectExpr("event_type", "tier", "n").collect()} == {tuple(r) for r in events.groupBy("event_type", (events.user_id % 3).alias("tier")).count().collect()}


def test_memories_expire_after_their_time_to_live(spark, tmp_path):
    """Rows within the time to live belong to the memory that is open, later ones open the next; a row behind the watermark (7) is dropped."""
    import datetime as d
    import os
    import shutil
    import time

    day = d.datetime(2024, 1, 10)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    os.mkdir(tmp_path / "in")
    for i, rows in enumerate(([(1, day, 1, "view", 1.0)], [(2, day + d.timedelta(days=1), 1, "view", 1.0), (3, day + d.timedelta(days=4), 2, "view", 1.0)], [(6, day + d.timedelta(days=4), 3, "view", 1.0)], [(4, day + d.timedelta(days=5), 1, "view", 1.0), (5, day + d.timedelta(days=5), 2, "view", 1.0), (7, day + d.timedelta(hours=1), 4, "view", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{i}")
        for f in (tmp_path / str(i)).glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    out = jobs.run_once(jobs.live_memory(jobs.event_stream(spark, f"file://{tmp_path}/in", 1), 48), "append")
    assert sorted(r.event_id for r in out.collect()) == [1, 3, 4, 6]


def test_release_deletes_staged_tables(spark):
    df = storage.staged(spark.range(3))
    storage.release(spark)
    import os

    assert not os.path.exists(f"{storage.shared_folder(spark).removeprefix('file://')}/engine/{spark.sparkContext.applicationId}") and df.columns == ["id"]


def test_sentences_and_tautologies_equal_plain_python(spark):
    import hashlib
    import re

    from mnemospark import queries

    texts = {r.doc_id: r.text for r in tables.base(spark, SF, "documents").collect()}
    for r in queries.queries()["t17_sentences"](spark, SF).collect():
        safe = re.sub(r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc)\.", "\\1\x01", texts[r.doc_id])
        safe = re.sub(r"(\d)\.(\d)", "\\1\x01\\2", safe)
        parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-ZÀ-ÖØ-Þ])", safe)
        want = [s for s in (x.replace("\x01", ".").strip(" ") for x in parts) if s]
        assert (r.sentences, r.digest) == (len(want), hashlib.md5("\x01".join(want).encode()).hexdigest())
    for r in queries.queries()["t27_tautologies"](spark, SF).collect():
        low = texts[r.doc_id].lower()
        assert r.circular == bool(re.search(r"because\s+it\s+is|proves?\s+itself", low))


def test_consolidation_compares_all_vectors(spark):
    v = tables.vectors(spark, SF)
    rows = v.orderBy("id").collect()
    ids = [r.id for r in rows]
    m = np.array([r.v for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want, kept = set(), []
    for i in range(len(ids)):
        by = next((k for k in kept if m[k] @ m[i] > 0.3), None)
        if by is None:
            kept.append(i)
        else:
            want.add((ids[i], ids[by]))
    assert any(a % 20 and b % 20 for a, b in want)
    for small in (10_000, 100, 0):
        assert {(r.id, r.kept_by) for r in vectors.consolidated(v, 0.3, small=small).collect()} == want
    assert vectors.consolidated(v.limit(0), 0.3).count() == 0


def test_ways_back_of_up_to_ten_steps_close_a_cycle(spark):
    ring = [(100 + i, 100 + (i + 1) % 11, 1.0) for i in range(11)]  # each way back has ten steps
    long = [(200 + i, 200 + (i + 1) % 12, 1.0) for i in range(12)]  # eleven
    e = edges(spark, [*ring, *long, (7, 8, 1.0), (9, 9, 1.0)])
    want = {(a, b, a < 200) for a, b, _ in ring + long} | {(7, 8, False), (9, 9, True)}
    assert {tuple(r) for r in cycles.closing(e, e, 10).collect()} == want


def test_conflicts_equal_unblocked_brute_force(spark):
    from difflib import SequenceMatcher

    from mnemospark.operators import near_texts

    r = random.Random(4)
    rows = [(x.doc_id, x.text) for x in tables.base(spark, SF, "documents").where("n_chars < 3000").limit(60).collect()]
    for i in range(160):
        w = r.choices(["a", "b", "c", "d", "e", "f"], k=r.randint(1, 12)) if i % 2 else r.choice(rows)[1].split()[:120]
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w)) if r.random() < 0.5 else 0] = f"x{r.randrange(9)}"  # often in the head
        rows.append((10**6 + i, r.choice([" ", "\n", "\u00a0 "]).join(w)))
    rows += [(1, None), (2, " "), (3, "one"), (4, "one ")]
    first = {}
    for i, t in sorted(rows):
        if t and t.split():
            first.setdefault(tuple(t.split()), []).append(i)
    want = {(ids[0], i, "member") for ids in first.values() for i in ids[1:]}
    reps = sorted((ids[0], w) for w, ids in first.items())
    for k, (i, x) in enumerate(reps):
        for j, y in reps[k + 1 :]:
            if (s := SequenceMatcher(None, x, y, autojunk=False).ratio()) > 0.85:
                want.add((i, j, "duplicate" if s > 0.95 else "overlap"))
    got = near_texts.conflicts(spark.createDataFrame(rows, "id long, text string"))
    assert {(r.a, r.b, r.kind) for r in got.collect()} == want
    texts = {i: " ".join(w) for w, ids in first.items() for i in ids}
    assert any(k != "member" and texts[a][:80] != texts[b][:80] for a, b, k in want)


def test_cycles_of_up_to_six_nodes(spark):
    from itertools import permutations

    ring = [(100 + i, 100 + (i + 1) % 6, 1.0) for i in range(6)] + [(200 + i, 200 + (i + 1) % 7, 1.0) for i in range(7)]
    pairs = random_edges(6, 8, 22)
    near = {(a, b) for a, b, _ in pairs}
    want = {p for n in range(2, 7) for p in permutations(range(8), n) if p[0] == min(p) and all(x in near for x in zip(p, p[1:] + p[:1]))}
    assert {len(p) for p in want} >= {4, 5}
    got = [tuple(r.path) for r in graph.cycles(edges(spark, pairs + ring), 6).collect()]
    assert sorted(got) == sorted(want | {tuple(range(100, 106))})


def test_a_long_chain_is_acyclic(spark):
    assert cycles.cyclic_edges(edges(spark, [(i, i + 1, 1.0) for i in range(53)])).count() == 0


def test_graph_operators_take_odd_edges(spark):
    e = spark.createDataFrame([(1, 2, 0.5, "x"), (1, 2, 0.9, "x"), (2, 2, 1.0, "x"), (2, 3, None, "x"), (None, 3, 1.0, "x"), (3, None, 1.0, "x"), (3, 1, 1.0, "x")], "a long, b long, strength double, depth string")
    none = e.limit(0)
    seed = spark.createDataFrame([(1,), (1,), (None,)], "seed long")
    assert {(r.id, r.depth) for r in graph.reach(e, seed, 3).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.id, r.parent, r.strength) for r in graph.chain(e, 1, 1).collect()} == {(1, None, 1.0), (2, 1, 0.9)}
    assert {tuple(r.path) for r in graph.cycles(e, 4).collect()} == {(1, 2, 3)}
    assert {tuple(r.path) for r in graph.paths(e, 1, 3, 3).collect()} == {(1, 2, 3)}
    assert {(r.a, r.b) for r in cycles.cyclic_edges(e).collect()} == {(1, 2), (2, 2), (2, 3), (3, 1)}
    assert {(r.a, r.b) for r in graph.both_ways(e).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 1), (1, 3)}
    assert len(graph.activation(e, spark.createDataFrame([(1, 1.0)], "id long, activation double"), 2, 0.1, 0.0).collect()) == 2
    for found in (graph.cycles(none, 4), graph.paths(none, 1, 2, 3), cycles.cyclic_edges(none), graph.pagerank(none), graph.betweenness(none, none.selectExpr("a AS id")), graph.betweenness(none, none.selectExpr("a AS id"), -1), cycles.closing(none, none, 3)):
        assert found.count() == 0


def test_long_ways_are_stripped(spark):
    """A path of 60 edges is no cycle, and one that hangs on both sides of a cycle goes."""
    path = [(i, i + 1, 1.0) for i in range(60)]
    assert cycles.cyclic_edges(edges(spark, path)).count() == 0
    ring = [(100, 101, 1.0), (101, 100, 1.0), (60, 100, 1.0), (101, 200, 1.0)] + [(200 + i, 201 + i, 1.0) for i in range(20)]
    assert {(r.a, r.b) for r in cycles.cyclic_edges(edges(spark, path + ring)).collect()} == {(100, 101), (101, 100)}


def test_equations_are_found(spark):
    r = random.Random(4)
    rows = [(x, y, 0.3 + 2 * x * y) for x, y in ((r.random(), r.random()) for _ in range(300))] + [(None, 0.5, 1.0), (0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    fits = learning.symbolic_fits(df, "z", ["x", "y"]).collect()
    best = max((f for f in fits if f.best), key=lambda f: f.r2)
    assert best.expression == "x * y" and abs(best.slope - 2) < 1e-9 and abs(best.intercept - 0.3) < 1e-9
    assert all(f.complexity <= 4 for f in learning.symbolic_fits(df, "z", ["x", "y"], 4).collect())
    assert not any(f.best for f in learning.symbolic_fits(df.limit(0), "z", ["x", "y"]).collect())


def test_chunkers_take_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "One two. Three.", 5), (3, "x" * 30_000 + ". Y.", 5), (4, " \n ", 5), (4, "One.", 5), (4, "One.", 5)], "id long, text string, chunk int")
    none = rows.limit(0)
    assert sorted((r.id or 0, r.chunk) for r in chunking.chunked(rows, 10, 1).collect()) == [(0, 0), (0, 1), (3, 0), (3, 1), (4, 0), (4, 0)]
    assert {r.id for r in chunking.semantic(rows, 10, 0.1).collect()} == {None, 3, 4} == {r.id for r in chunking.located(rows, 10, 0).collect()}
    assert {r.id: len(r.summary) for r in chunking.summaries(rows.where("id < 4"), 20).collect()} == {1: 0, 2: 0, 3: 2}
    for f in (chunking.chunked(none, 10, 1), chunking.semantic(none, 10, 0.1), chunking.located(none, 10, 0), chunking.summaries(none, 10)):
        assert f.count() == 0


def test_named_phrases_equal_plain_python(spark):
    import re

    from mnemospark import queries

    texts = {(r.conv_id, r.turn): r.text for r in tables.base(spark, SF, "conversations").collect()}
    got = {(r.conv_id, r.turn): r.phrases for r in queries.queries()["t03_named_phrases"](spark, SF).collect()}
    for key, text in texts.items():
        found = [m[0] for m in re.finditer(r"\b[A-Z][a-zA-Z]+(?:[ \t\n\x0b\f\r]+[A-Z][a-zA-Z]+)*\b", text or "")]
        assert got[key] == len(found) - bool(found and text.startswith(found[0]))


def test_summaries_take_the_best_sentences_that_fit(spark):
    """Every sentence left out scores less than one taken, or did not fit when its turn came."""
    r = random.Random(5)
    for _ in range(50):
        sentences = [" ".join(r.choices(["alpha", "betas", "gamma", "is", "of"], k=r.randint(1, 12))).capitalize() + "." for _ in range(r.randint(1, 9))]
        text = " ".join(sentences)
        long = [w for s in sentences for w in s.lower().split() if len(w) > 4]
        score = [1 / (1 + i) + min(len(s), 200) / 400 + sum(long.count(w) for w in s.lower().split() if len(w) > 4) / (10 * (1 + len(s.split()))) for i, s in enumerate(sentences)]
        taken, size = set(), 0
        for i in sorted(range(len(sentences)), key=lambda i: (-score[i], i)):
            if size + len(sentences[i]) + 1 <= 90:
                taken.add(i)
                size += len(sentences[i]) + 1
        assert chunking.summary(text, 90) == " ".join(sentences[i] for i in sorted(taken))


def test_a_temporary_folder_is_made_in_local_mode_only():
    import pytest

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def test_analytics_take_odd_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 0.9, 1), ("a", None, 2), ("a", 0.9, 3), (None, 0.2, 1), ("b", None, 1)], "g string, p double, t int")
    none = df.limit(0)
    assert {r.g: (r.votes, r.yes, r.accepted) for r in analytics.vote(df, "g", F.col("p") > 0.5).collect()} == {"a": (3, 2, True), None: (1, 0, False), "b": (1, 0, False)}
    assert math.isclose({r.g: r.confidence for r in analytics.claim_confidence(df, "g", "p").collect()}["a"], 0.3 * 0.03 + 0.25 * 0.9 + 0.25 + 0.2)
    assert [(r.g, r.d) for r in analytics.changes(df, "g", ["t"], "p").collect()] == []
    assert {r.g: r.gain for r in analytics.improvement(df, "g", "p", F.col("t") < 2).collect()} == {"a": 0.0, None: None, "b": None}
    assert {r.v for r in df.select(analytics.first_rule({"missing": F.col("p").isNull(), "low": F.col("p") < 0.5}, "fine").alias("v")).collect()} == {"missing", "low", "fine"}
    assert [(r.t, r.score) for r in topk.two_stage(df.where("g = 'a'"), "p", 2, F.col("p") * 2, 5, "t").collect()] == [(1, 1.8), (3, 1.8)]
    assert {(r.g, r.t) for r in topk.learnings(df, "g", "g", "t", F.coalesce(F.col("p") > 0.5, F.lit(False)), 2, "t").collect()} == {("a", 2), ("a", 3), (None, 1), ("b", 1)}
    for f in (analytics.vote(none, "g", F.col("p") > 0.5), analytics.attention(none, "g", "p", "p"), analytics.evictable(none, "g", "p", "p", 3), analytics.flexibility(none, "g", "p"), analytics.citation_summary(none, "g", F.col("t"), F.col("p") > 0)):
        assert f.count() == 0


def test_settings_come_back_when_the_last_thread_leaves(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    a, b = storage.setting(spark, key, "true"), storage.setting(spark, key, "true")
    a.__enter__(), b.__enter__()
    a.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"
    b.__exit__(None, None, None)
    assert spark.conf.get(key) == old


def test_longest_common_subsequences(spark):
    from mnemospark.operators import near_texts

    r = random.Random(12)
    for _ in range(300):
        p, q = ([r.choice("abcd") for _ in range(r.randrange(15))] for _ in range(2))
        row = [0] * (len(q) + 1)
        for x in p:
            before = 0
            for j, y in enumerate(q, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert near_texts.longest_common(p, q) == row[-1]
