"""The pipeline's stages against plain Python over the same rows."""

import re

import public_tokenizers

import corpus_pipeline as P
from mnemospark.llm import jaccard_join
from mnemospark.llm._common import release, staged
from mnemospark.sources.storage import shared_folder
from mnemospark.llm._words import load_tokenizer
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard_join import brute as classes


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in P.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    first = seen["language_id"]
    assert set(first) == {i for i, t in rows.items() if re.search(r"[^\W\d_]", t or "")}
    groups = {}
    for i in first:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i]), []).append((-len(rows[i]), i))
    assert set(seen["exact_dedup"]) == {min(g)[1] for g in groups.values()}
    near = classes([(i, rows[i]) for i in seen["exact_dedup"]], P.NEAR_WORDS, P.NEAR_PERCENT)
    assert set(seen["near_dedup"]) == {i for i, (_, c) in near.items() if c == i}
    found = hits([(i, rows[i]) for i in seen["near_dedup"]], bench, 13)
    assert set(seen["decontaminate"]) == {i for i, x in found.items() if not x[3]}
    t = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.ids for i, r in seen["bpe_encode"].items()} == {i: t.encode(rows[i], add_special_tokens=False).ids for i in seen["decontaminate"]}


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 0


def test_lazy_chaining_and_odd_columns(spark, sf_dir):
    rows = [(1, "the dog and the cat ran home", "en", "s", 3, 0.5), (2, "the dog  and the cat ran home", "en", "s", 3, 0.5), (3, None, None, None, None, None), (4, "12", "en", "s", 1, 0.1), (5, "a very different text of other words", "en", None, 2, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 5]
    assert {r.score for r in out.collect()} == {0.5, 0.2}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_do_not_touch_each_others_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = P.drop_near_copies(spark, docs.where("doc_id % 2 = 0"), sf_dir)
    b = P.drop_near_copies(spark, docs.where("doc_id % 2 = 1"), sf_dir)
    c = P.drop_exact_copies(spark, docs, sf_dir)
    n = b.count()
    assert a.count() > 0 and n > 0 and c.count() > 0
    release(a)
    release(c)
    assert b.count() == n


def tables(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/mnemospark/{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def test_runs_at_once_and_what_they_leave(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    before = tables(spark)
    with ThreadPoolExecutor(2) as pool:
        outs = list(pool.map(lambda _: P.run(spark, sf_dir), range(2)))
    left = tables(spark) - before
    assert sorted(x.rsplit("-", 1)[0] for x in left) == ["bpe_encode", "bpe_encode"]
    x, y = (sorted(map(tuple, o.collect())) for o in outs)
    assert x == y and x
    for o in outs:
        release(o)
    assert tables(spark) == before


def test_failed_operators_leave_nothing(spark):
    import pytest
    from pyspark.sql import functions as F

    before = tables(spark)
    bad = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumn("text", F.raise_error(F.lit("no text")).cast("string"))
    with pytest.raises(Exception, match="no text"):
        jaccard_join.cluster(bad)
    assert tables(spark) == before
