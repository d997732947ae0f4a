import random
import re
from itertools import combinations

import pytest

from mnemospark.llm import jaccard_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, t):
    sets = {i: grams(x, n) for i, x in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= t * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= t * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 160))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            k = r.randrange(len(w) + 1)
            op = r.random()
            if op < 0.4 and k < len(w):
                w[k] = r.choice(vocabulary)
            elif op < 0.7:
                w.insert(k, r.choice(vocabulary))
            elif w and k < len(w):
                del w[k]
        rows.append((i, " ".join(w).upper() if r.random() < 0.1 else "\n".join(w) if r.random() < 0.1 else " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]
    return rows


@pytest.mark.parametrize("n,t,seed,block", [(3, 90, 1, 4_000_000), (5, 80, 2, 4_000_000), (3, 80, 3, 2_000), (2, 50, 4, 3_000)])
def test_cluster_equals_brute_force(spark, n, t, seed, block):
    rows = corpus(seed, 240)
    got = J.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, t, block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, n, t)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.cluster(empty).count() == 0
    rows = spark.createDataFrame([(2, "a b c", 7), (1, "a b c", 8), (None, "a b c", 9)], "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.component_id) for r in J.cluster(rows, 2, 90).collect()}
    assert got == {(1, 1), (2, 1), (None, 1)}
    kept = J.keep_one(rows.where("doc_id IS NOT NULL"))
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1]


def test_similar_sets_share_a_key():
    import numpy as np

    r = np.random.default_rng(5)
    for t in (50, 80, 90):
        for size in (5, 10, 23, 60, 200, 900):
            x = np.unique(r.integers(0, 2**62, size).astype(np.uint64))
            differ = (2 * len(x)) * (100 - t) // (100 + t)
            k = differ // 2
            y = np.unique(np.concatenate([x[k:], r.integers(0, 2**62, k).astype(np.uint64)]))
            off = np.array([0, len(x), len(x) + len(y)])
            keys, own = J.bucket_keys(np.concatenate([x, y]), off, t)
            if k:
                assert set(keys[own == 0]) & set(keys[own == 1]), (t, size)


@pytest.mark.parametrize("block", [400, 1_500, 100_000])
def test_a_large_family_in_blocks(spark, block):
    """Near copies of one text, some far from most, beside families that only meet through one member."""
    r = random.Random(block)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(60), r.choice([0, 1, 1, 2, 3])):
            w[k] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    for step in range(25):  # a chain: each is near the one before only
        w = list(base)
        w[: 2 * step] = [f"c{k}" for k in range(2 * step)]
        rows.append((1000 + step, " ".join(w)))
    rows += [(2000 + i, rows[r.randrange(len(rows))][1]) for i in range(30)]
    r.shuffle(rows)
    got = J.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80, block)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute(rows, 3, 80)


def test_rows_without_an_id_carry_no_link(spark):
    rows = [(None, "a b c d e f g h i j x"), (3, "a b c d e f g h i j k"), (5, "a b c d e f g h i j l"), (None, "zz yy")]
    got = {(r.doc_id, r.component_id) for r in J.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {(3, 3), (5, 3), (None, None)}


def test_keys_move_packed_in_parts_of_bounded_size():
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    texts = pa.array([" ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(1, 400))) for _ in range(300)] + [None, ""])
    grams, off = J.ngram_sets(texts, 5)
    key, own = J.bucket_keys(grams, off, 80)
    counts = J.key_counts(np.diff(off), 80)
    assert counts.tolist() == np.bincount(own, minlength=len(texts)).tolist() and counts.sum() > 10_000
    parts = 7
    rows = pa.Table.from_batches(J._keyed(5, 80, parts)(iter([pa.record_batch([texts], names=["text"])]))).to_pylist()
    keys = [x for x in rows if not x["met"]]
    assert sorted(x["part"] for x in keys) == list(range(parts)) and len(rows) <= 2 * parts  # not a row a key
    unpacked = [np.frombuffer(x["x"], np.int64) for x in keys]
    assert sorted(np.concatenate(unpacked).tolist()) == sorted({*key.view(np.int64).tolist()})
    assert max(map(len, unpacked)) < 1.2 * len(np.unique(key)) / parts
    assert all(len(x["x"]) == len(x["y"]) for x in rows)


@pytest.mark.parametrize("part_keys", [50, 1_000])
def test_classes_do_not_depend_on_the_parts(spark, monkeypatch, part_keys):
    monkeypatch.setattr(J, "PART_KEYS", part_keys)
    rows = corpus(9, 160)
    got = J.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute(rows, 3, 80)


def test_chance_meetings_make_no_large_group(spark, monkeypatch):
    """Texts of few words meet by chance in some bucket: most are one candidate group, with hardly a similar pair in it."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(14)], [1 / (k + 1) for k in range(14)], k=20))) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " w3") for i in range(40)]
    crossed, across = [], J._across
    monkeypatch.setattr(J, "_across", lambda *x: (out := across(*x), crossed.append(out.count()))[0])
    got = J.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80, 1_500)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute(rows, 3, 80)
    assert sum(crossed) < len(rows)


def test_blocks_are_compared_in_turns(spark, monkeypatch):
    """A family that is no chance: its texts go to every other block, and what moves at once is bounded."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(60), 6):
            w[k] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    moved, staged = [], J.staged

    def watched(df, name):
        out = staged(df, name)
        if name == "tasks":
            moved.extend(t.join(out.select("rep", "size").distinct(), "rep").agg({"size": "sum"}).first()[0] for t in J._turns(out, 3000))
        return out

    monkeypatch.setattr(J, "staged", watched)
    got = J.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 60, 300)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute(rows, 3, 60)
    assert len(moved) > 3 and max(moved) < 3 * 3000
