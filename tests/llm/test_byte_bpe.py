"""Byte-level BPE against tiktoken."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from mnemospark.llm import byte_bpe as B
from mnemospark.llm import queries as Q

ALPHABET = [*"aab'st rell  \n\t\r.,!0123-=_", "é", "ü", "中", "́", "‍", "\U0001f642", "\U0001f1e9", "\x00", "\x1c", "\x85", " ", " ", " ", " ", " ", " ", "　", "İ", " ", "​", "、", "<|endoftext|>", "Paraguay ", " the", "don't "]


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(Q.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec(spark):
    return B.Codec(spark, Q.RANKS, public_tokenizers.PATTERN)


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) * r.choice((1, 1, 1, 2, 9)) for _ in range(r.randrange(80))) for _ in range(n)]


def test_ids_and_offsets(codec, truth):
    texts = [*some_texts(3000, 1), "", "." * 5000, "a" * 3000, "中" * 2000 + " x"]
    column = pa.array([*texts, None], pa.string())
    ids, off = codec.model.encode(column)
    starts, ends = codec.model.offsets(column, ids, off)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == truth.encode_ordinary(t), t
        at = 0
        for i, a, b in zip(ids[off[k] : off[k + 1]].tolist(), starts[off[k] :].tolist(), ends[off[k] :].tolist()):
            token = truth.decode_single_token_bytes(i)
            first, last = len(t.encode()[:at].decode("utf-8", "ignore")), t.encode()[: at + len(token)].decode("utf-8", "replace")
            assert (a, b) == (first, len(last)), (t, at)
            at += len(token)
    assert off[-1] == off[-2]


def test_every_part_of_a_token_is_found():
    ranks = B.load_ranks(Q.RANKS)
    assert all(B.parts_of(t, ranks) for t in ranks if len(t) > 1)
    assert len(set(B.byte_chars())) == 256


def test_decoding_of_split_characters(codec):
    model = codec.model
    text = "a\U0001f9ff中\U0001f1e9b ฿" * 3
    ids = model.encode(pa.array([text]))[0]
    whole = model.bytes_of(ids)[0].tobytes()
    assert whole.decode() == text
    for size in (1, 2, 3):
        assert "".join(B.decode_parts([ids[k : k + size].tolist() for k in range(0, len(ids), size)], model)) == text
    assert "".join(B.decode_parts([ids[:2].tolist()], model)) == model.bytes_of(ids[:2])[0].tobytes().decode("utf-8", "replace")
    with pytest.raises(ValueError):
        model.bytes_of(np.array([60_000]))


def test_a_pattern_that_joins_white_space_is_refused(spark):
    with pytest.raises(ValueError):
        B.Codec(spark, Q.RANKS, r"\S+\s*|\s+")
    with pytest.raises(ValueError):
        B.Codec(spark, Q.RANKS, r"\p{L}+")


def test_columns(spark, codec, truth):
    rows = [(1, "café \U0001f9ff", 7), (1, "café \U0001f9ff", 7), (2, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offsets int").withColumnRenamed("offsets", "ids")
    got = B.decode(B.encode(docs, codec, offsets=True), codec).collect()
    assert sorted([(r.doc_id or 0, r.text, r.decoded) for r in got], key=str) == sorted([(a or 0, t, t or "") for a, t, _ in rows], key=str)
    for r in got:
        assert r.ids == truth.encode_ordinary(r.text or "") and len(r.offsets) == len(r.ids)
    assert B.decode(B.encode(docs.limit(0), codec), codec).count() == 0
    bad = spark.createDataFrame([([truth.encode_ordinary("\U0001f9ff")[0]],), (None,)], "ids array<int>")
    assert {r.decoded for r in B.decode(bad, codec).collect()} == {truth.decode_single_token_bytes(truth.encode_ordinary("\U0001f9ff")[0]).decode("utf-8", "replace"), ""}


def test_query_equals_tiktoken(spark, sf_dir, truth):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op13_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = truth.encode_ordinary(d.text or "")
        assert got[d.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
