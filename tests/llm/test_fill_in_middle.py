"""Fill-in-the-middle against plain regular expressions (the query against its SQL: test_oracles)."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import fill_in_middle as M

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "bc", "\n", " ", "\n\n", "\t", "<", "P>", "<S", "é\U0001f642", "<P", "M", "\r\n"]) for _ in range(r.randrange(30))) for _ in range(n)]


def plain(key, text, unit, seed=7, rate=100, spm=50):
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = re.findall(UNITS[unit], text)
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("word", 70, 10), ("char", 100, 100)])
def test_equals_regular_expressions(spark, unit, rate, spm):
    texts = dict(enumerate([*some_texts(400, 5), "", "x", "\n", "a\nb", "<P>", "a<M>b", "line\n" * 30000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = M.transform(docs, unit=unit, rate=rate, spm=spm).withColumn("back", M.restored()).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id], unit, rate=rate, spm=spm)
        assert r.back == r.text == texts[r.doc_id]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a\nb\n", "x"), (1, None, "y"), (2, "q", "z"), (2, "q", "z")], "doc_id long, text string, form string")
    got = M.transform(docs).withColumn("back", M.restored()).collect()
    assert sorted((r.back, r.form == "plain") for r in got) == [("", True), ("a\nb\n", False), ("q", False), ("q", False)]
    assert {(r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.doc_id is None} == {plain("", "a\nb\n", "line")}
    assert M.transform(docs.where("false")).count() == 0
    assert "text" not in M.transform(docs, keep_text=False).columns


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("aba", "bab", "c"), ("<P>", "<P>x", "<M>"), ("", "a", "b"), ("a a", "b", "c"), ("xyx", "q", "r")])
def test_ambiguous_sentinels_are_refused(spark, sentinels):
    with pytest.raises(ValueError):
        M.transform(spark.createDataFrame([], "doc_id long, text string"), sentinels=sentinels)


def test_other_sentinels(spark):
    own = ("[|pre|]", "[|suf|]", "[|mid|]")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a\n[|\nb", "(|x\ny\n.*\\Q\\E\n", "[|pre|]"] * 20)], "doc_id long, text string")
    got = M.transform(docs, sentinels=own, spm=50).withColumn("back", M.restored(sentinels=own)).where(F.col("back") != F.col("text"))
    assert got.count() == 0
