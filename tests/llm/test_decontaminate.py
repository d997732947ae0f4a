import random
import re

import pytest

from mnemospark.llm import decontaminate as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, size):
    windows = {}
    for name, t in items:
        w = words(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    own |= names
        out[d] = (len(w), len(hit), sorted(str(n) for n in own if n is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def tables(seed):
    r = random.Random(seed)
    v = ["ab", "Cd", "é", "x1", "zz", "Q"]
    items = [(i % 9, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 3, 6, 12])))) for i in range(14)] + [(None, "zz zz zz Q"), (20, None), (21, " ,. ")]
    docs = []
    for i in range(120):
        parts = [" ".join(r.choice(v) for _ in range(r.randint(0, 40)))]
        if r.random() < 0.5:
            parts.append((r.choice(items)[1] or "").replace(" ", ", "))
        docs.append((i, "\n".join(parts)))
    return [*docs, (900, None), (901, ""), (902, "..."), (903, docs[0][1])], items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_brute_force(spark, limit):
    docs, items = tables(3)
    found = D.scan(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 6, max_bytes=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()} == brute(docs, items, 6)


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, three four! And that."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "one two three four")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.remove_documents(docs, bench).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()} == {1: "Keep this. ! And that.", 2: "clean", 3: None}
    assert D.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.scan(docs.limit(0), bench).count() == 0
