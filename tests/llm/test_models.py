import numpy as np
import pyarrow as pa

from mnemospark.llm import language_id as L
from mnemospark.llm import quality as Q
from mnemospark.llm import queries


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 20 and right / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "123 !?", None), (5, "", "de"), (6, "the dog and the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df.withColumnRenamed("lang", "score"), model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["de", "en", "und", "und", "und", "en"] and got[3][1] == 0.0
    none = L.train(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), model).count() == 0


def test_long_texts_are_scored_whole(monkeypatch):
    m = L.Model(["a", "b"], np.random.default_rng(1).random((2, L.BUCKETS + 1)).astype(np.float32))
    m.weights[:, L.BUCKETS] = 0
    for t in ("abcd efgh " * 400 + "İΣ xΣ", "", "a", "ab", "abc " * 250, "x" * 999):
        whole = L.log_likelihoods(m, [t, "z", t])
        for size in (1, 2, 3, 7, 1000):
            monkeypatch.setattr(L, "SLICE_CHARS", size)
            assert np.allclose(L.log_likelihoods(m, [t, "z", t]), whole, rtol=1e-12, atol=1e-9)
        monkeypatch.setattr(L, "SLICE_CHARS", 1 << 20)


def bucket(gram):
    """The hash of an n-gram, by plain numbers."""
    h, size = 0, 1 << 64
    for c in gram:
        h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 % size
        h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 % size) >> 49


def test_language_equals_plain_naive_bayes(spark, sf_dir):
    """Counts, smoothing and posteriors of the contract query in dictionaries and plain loops."""
    import math
    import re
    import zlib
    from collections import Counter

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = {r.doc_id: Counter(bucket(p[i : i + n]) for p in [f" {(r.text or '').lower()} "] for n in (1, 2, 3) for i in range(len(p) - n + 1)) for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id] and r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams[r.doc_id])
    total = {k: sum(c.values()) + 0.5 * L.BUCKETS for k, c in counts.items()}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        ll = {k: sum(n * math.log((c[g] + 0.5) / total[k]) for g, n in grams[r.doc_id].items()) for k, c in counts.items()}
        best = max(sorted(ll), key=ll.get)
        p = 1 / sum(math.exp(x - ll[best]) for x in ll.values())
        known = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert got[r.doc_id].held_out == held[r.doc_id]
        assert got[r.doc_id].lang_pred == (best if known else "und")
        assert abs(got[r.doc_id].score - (p if known else 0)) < 1e-3  # the matrix is in single precision


def test_quality_of_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    got = queries.op10_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.9


def test_pairwise_fit_equals_gradient_descent():
    """The weights are the minimum of the loss over the very pairs, and the map to probabilities that of its own loss."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    y = (x @ [1, -0.1, 4, 0] + r.normal(size=300) > 0.3).astype(int)
    model = Q.fit(x, y, max_pairs=2000, seed=9)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    again = np.random.default_rng(9)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[again.choice(good, 2000)] - z[again.choice(bad, 2000)]
    w = np.zeros(4)
    for _ in range(20_000):  # mean of log(1 + exp(-d w)) and 0.001 |w|^2
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.002 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    s, slope, intercept = z @ w, 0.0, 0.0
    for _ in range(50_000):
        e = 1 / (1 + np.exp(-(slope * s + intercept))) - y
        slope, intercept = slope - 0.5 * ((e * s).mean() + 1e-3 * slope / 300), intercept - 0.5 * (e.mean() + 1e-3 * intercept / 300)
    assert np.allclose([model.slope, model.intercept], [slope, intercept], atol=1e-4)
    p = Q.probability(model, x)
    assert np.allclose(p, 1 / (1 + np.exp(-(slope * s + intercept))), atol=1e-4)


def test_features_equal_plain_counts():
    import math
    import re
    from collections import Counter

    t = "Ab ab, ab!\nA line.\nA line.\n\né 12 $5"
    x = Q.features(pa.array([t]))[0]
    raw = t.encode()
    k = len(Q.CLASSES)
    for i, chars in enumerate(Q.CLASSES.values()):
        share = sum(t.count(c) for c in chars) / len(t)
        assert np.isclose(x[i], share) and np.isclose(x[k + i], math.log1p(200 * share))
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sizes = [len(w.encode()) for w in words]
    n, lines = len(words), re.findall(r"[^\r\n]+", low)
    mean = sum(sizes) / n
    pairs = list(zip(words, words[1:]))
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
    want = [entropy, mean, math.sqrt(sum(s * s for s in sizes) / n - mean**2), math.log1p(mean), len(set(words)) / n, max(Counter(words).values()) / n, sum(a == b for a, b in pairs) / n]
    want += [len(set(pairs)) / (n - 1), len(set(lines)) / len(lines), math.log1p(n), math.log1p(n) * len(set(words)) / n, math.log1p(len(lines)), sum(b > 127 for b in raw) / len(t)]
    assert np.allclose(x[2 * k :], want)


def test_predictions_follow_the_scores(spark, sf_dir):
    import zlib

    got = queries.op10_quality(spark, sf_dir).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got} == ids and len(got) == len(ids)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_quality_edge_cases(spark):
    texts = ["Good plain prose here. It goes on.", "BUY!!! NOW!!! $$$", None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (9, 1), (0, 1)], "doc_id long, quality int")
    model = Q.train(df, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in Q.score(df, model).collect()}
    assert got[0][0] > got[1][0] and all(0 <= s <= 1 and p == int(s >= 0.7) for s, p in got.values()) and got[2] == got[3]
    alone = Q.train(df, labels.where("quality = 1"))
    assert len({r.score for r in Q.score(df, alone).collect()}) == 1
    assert Q.select_quantile(Q.score(df, model), 0.5).count() >= 3
    assert Q.score(df.limit(0), model).count() == 0


def test_features_do_not_depend_on_neighbours():
    t = ["a b a b\nA! é", "zz", None, "||| | $$"]
    together = Q.features(pa.array(t))
    for i, x in enumerate(t):
        assert np.allclose(Q.features(pa.array([x], pa.string()))[0], together[i])


def test_folds_are_crc32_of_the_id(spark):
    import zlib

    rows = spark.range(500).withColumnRenamed("id", "doc_id").select("doc_id", L.held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_bounded_samples_are_the_smallest_hashes(spark):
    from mnemospark.llm._common import bounded

    df = spark.range(20_000).withColumnRenamed("id", "doc_id").repartition(7)
    few = {r.doc_id for r in bounded(df, "doc_id", 300, 5).collect()}
    more = {r.doc_id for r in bounded(df, "doc_id", 12_000, 5).collect()}
    assert len(few) == 300 and len(more) == 12_000 and few <= more
    assert bounded(df.limit(5), "doc_id", 300, 5).count() == 5


def test_many_rows_of_one_id_come_as_one(spark):
    """Labels choose documents by id; of 20,000 rows with two ids the driver gets two."""
    docs = spark.range(20_000).selectExpr("id % 2 AS doc_id", "concat('Good text, number ', id, '. It goes on.') AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (None, 1)], "doc_id long, quality int")
    seen = []
    real, Q.fit = Q.fit, lambda x, y, *rest: seen.append((len(x), sorted(y.tolist()))) or real(x, y, *rest)
    try:
        model = Q.train(docs, labels, max_rows=10)
    finally:
        Q.fit = real
    assert seen == [(3, [0, 1, 1])]
    last = Q.train(spark.createDataFrame([(0, "Good text, number 9998. It goes on."), (1, "Good text, number 9999. It goes on.")], "doc_id long, text string"), labels)
    assert np.allclose(model.weights, last.weights) and np.allclose(model.mean, last.mean)


def test_many_languages_have_a_bounded_model(spark):
    rows = [(k, f"text of language {k}", f"l{k:05}") for k in range(5000)] + [(10_000 + k, "viele Worte und noch mehr Worte", "de") for k in range(4)] + [(20_000 + k, "many words and still more words", "en") for k in range(3)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == L.MAX_LANGUAGES and {"de", "en", "l00000"} < set(model.languages) and model.weights.nbytes < 40e6
    two = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=2)
    assert two.languages == ["de", "en"]
    got = L.identify(spark.createDataFrame([("noch mehr Worte",), ("more words",)], "text string"), two)
    assert [r.lang_pred for r in got.collect()] == ["de", "en"]
