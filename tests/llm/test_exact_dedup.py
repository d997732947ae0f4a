import hashlib
import random
import re

from mnemospark.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_equals_brute_force_with_a_hot_group(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["same text", "same  text", "sametext\t", f"t {i % 40}", "", None, "é\x0b\x0c", "\xa0"]) if i % 3 else " ".join("same text")) for i in range(700)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, keep_id int").repartition(7)
    got = X.mark(df, ["doc_id"]).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got} == brute(rows)
    kept = X.deduplicate(df.drop("keep_id").withColumnRenamed("text", "text"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, v in brute(rows).items() if v[2])


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a "), (2, "b")], "doc_id long, text string")
    kept = sorted(((x.doc_id, x.text) for x in X.deduplicate(df).collect()), key=str)
    assert kept == [(2, "b"), (None, "a ")]
    assert X.mark(df.limit(0)).count() == 0


def test_range_of_a_key_counts_the_splitters_up_to_it(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    for n in (0, 1, 2, 7, 30):
        splitters = sorted({f"k{i * 37 % 101:03d}" for i in range(n)})
        keys = [f"k{i:03d}" for i in range(0, 102, 3)] + ["", "z"]
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        got = df.select("k", X._range_of(F.col("k"), splitters).alias("r")).collect()
        assert {r.k: r.r for r in got} == {k: bisect_right(splitters, k) for k in keys}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in X.mark(df)._jdf.queryExecution().toString()
