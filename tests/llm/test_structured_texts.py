"""Texts made to defeat algebraic hashes: the two complementary Thue-Morse words of each length."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mnemospark.llm import bpe, decontaminate, jaccard_join, suffix_dedup, token_files
from mnemospark.llm import _common as K
from mnemospark.llm._words import WordEncoder, load_tokenizer
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_suffix_dedup import brute as repeats

LENGTHS = [512, 1024, 2048, 4096, 8192]
PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_hashes_differ():
    for n in [8, 16, 64, 128, 256, *LENGTHS]:
        raw, off = K.flat_bytes(pa.array(thue_morse(n)))
        for kind in (K.HASH, K.HASH2):
            h = K.span_hashes(raw, off[:-1], off[1:], kind)[0]
            assert h[0] != h[1]
            w = K.word_windows(np.array([1, 2], np.uint64)[(raw == 98).astype(int)], [n], kind)[n]
            assert w[0] != w[n]
        if n <= 256:
            assert len(set(K.window_hashes(raw, n, K.HASH)[0][[0, n]].tolist())) == 2


def test_span_hashes_are_those_of_the_bytes_alone():
    r = np.random.default_rng(1)
    raw = r.integers(0, 3, 3000).astype(np.uint8)
    start = r.integers(0, 2500, 4000)
    end = start + r.integers(0, 500, 4000)
    h = K.span_hashes(raw, start, end, K.HASH, K.HASH2)
    seen = {}
    for a, b, x, y in zip(start, end, *h):
        assert seen.setdefault(raw[a:b].tobytes(), (x, y)) == (x, y)
    assert len(set(seen.values())) == len(seen)
    windows = K.window_hashes(raw, 11, K.HASH)[0]
    assert len({*windows.tolist()}) == len({raw[i : i + 11].tobytes() for i in range(len(windows))})


@pytest.mark.parametrize("n", LENGTHS)
def test_words_get_their_own_ids(n):
    e, t = WordEncoder(load_tokenizer(PATH)), load_tokenizer(PATH)
    for x in (*thue_morse(n), *thue_morse(n)):
        assert e.encode(pa.array([x]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_equal_hashes_do_not_make_words_equal(monkeypatch):
    monkeypatch.setattr("mnemospark.llm._words.span_hashes", lambda raw, start, end, *kinds: [np.full(len(start), 7, np.uint64) for _ in kinds])
    e, t = WordEncoder(load_tokenizer(PATH)), load_tokenizer(PATH)
    for x in ("one two", "two three one", "three", "longer words than eight bytes", "longer bytes", ""):
        assert e.encode(pa.array([x]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_operators(spark):
    rows, words = [], []
    for n in LENGTHS:
        words += thue_morse(n)
    for w in words:
        rows += [(len(rows), w), (len(rows) + 1, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = load_tokenizer(PATH)
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    encoded = bpe.encode(df, PATH, bpe.build_lexicon(df, PATH))
    assert {r.doc_id: r.ids for r in encoded.collect()} == ids
    files = token_files.digest_files(token_files.write_tokens(df, PATH))
    assert {r.doc_id: r.n_tokens for r in files.collect()} == {i: len(x) + 1 for i, x in ids.items()}
    classes = {r.doc_id: r.component_id for r in jaccard_join.cluster(df.where("text NOT LIKE '% %'"), 3, 90).collect()}
    assert classes == {i: i for i in classes} and len(classes) == len(words)
    got = suffix_dedup.remove_repeats(df.where("length(text) <= 2048"), 1024, texts=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeats([r for r in rows if len(r[1]) <= 2048], 1024)
    items = [(0, words[3]), (1, " ".join(words[0]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = hits(rows, items, 300)
    for most in (1 << 20, 0):
        found = decontaminate.scan(df, benchmark, 300, max_bytes=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in found} == want


def test_token_digests():
    from mnemospark.llm.queries import token_digests

    ids = pa.array([[5, 0, 65535], [], [7]], pa.list_(pa.int32()))
    n, a, b = token_digests(ids, pa.array(["x é", "", "y"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert n.to_pylist() == [3, 0, 1] and a.to_pylist() == [sha("5 0 65535"), sha(""), sha("7")] and b.to_pylist() == [sha("x é"), sha(""), sha("y")]


def test_other_tokenizers_are_refused(spark):
    df = spark.createDataFrame([(1, "Hello World, this is a test.")], "doc_id long, text string")
    other = public_tokenizers.path("byte_bpe_50k.json")
    for use in (lambda: bpe.build_lexicon(df, other), lambda: token_files.write_tokens(df, other)):
        with pytest.raises(ValueError, match="lower-cased words"):
            use()
