"""Trigram postings against plain containment."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import postings
from mnemospark.sources import storage


def test_search_equals_a_scan(spark):
    r = random.Random(8)
    words = ["Straße", "abc", "ABCD", "a_b%c", "ünï", "日本語", "x", "zz top", "end.", "middle of it", "\n"]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randrange(12))) for i in range(300)}
    rows = [*texts.items(), (7, "another abc text of the same id"), (None, "abc"), (400, None), (401, ""), (402, "q" * 300_000 + "needle" + "q" * 300_000)]
    index = postings.TrigramIndex(spark.createDataFrame(rows, "id long, text string").repartition(4))
    asked = ["abc", "BCD", "a_b", "%c", "ünï", "本", "日本語 日本", "x", "", "zz TOP", "of it end", "needle", "no such", "straße", "\n x"]
    got = index.search(asked).collect()
    want = {(p, i) for p in asked for i, t in rows if i is not None and t is not None and p.lower() in t.lower()}
    assert {(x.pattern, x.id) for x in got} == want and len(got) == len(want)
    assert postings.TrigramIndex(spark.createDataFrame([], "id long, text string")).search(["abc", "x"]).count() == 0


def test_a_search_opens_its_folders_only(spark):
    index = postings.TrigramIndex(spark.range(2000).select("id", F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text")))
    few = index._read(postings._grams(b"abcd").tolist())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(gram" in plan.replace("PushedFilters: [In(gram", "In(gram")
    assert len(set(index.rows.select("folder").distinct().collect())) == postings.FOLDERS
    likely = index.candidates(["ab12"]).count()
    assert likely < 500  # of 2,000 texts, few have both grams


def test_many_candidates_scan_the_texts(spark, monkeypatch):
    monkeypatch.setattr(postings, "MAX_IDS", 3)
    index = postings.TrigramIndex(spark.range(50).select("id", F.lit("one common text").alias("text")))
    assert index.search(["COMMON", "rare"]).count() == 50


def test_results_own_what_is_staged(spark):
    rows = spark.range(20).select("id", F.lit("text").alias("text"))
    kept = storage.owner(lambda: postings.TrigramIndex(rows).search(["text"]))()
    gone = storage.owner(lambda: postings.TrigramIndex(rows).search(["ext"]))()
    assert len(kept._owned) == 2 and not set(kept._owned) & set(gone._owned)
    storage.release(gone)
    assert kept.count() == 20
    fs = spark._jvm.org.apache.hadoop.fs.Path(gone._owned[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    exists = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert not any(map(exists, gone._owned)) and all(map(exists, kept._owned))
    storage.release(kept)
    assert not any(map(exists, kept._owned))
