import hashlib
import random

import numpy as np
import pytest

from mnemospark.llm import suffix_dedup as S
from mnemospark.llm._suffix import SuffixArray


def brute(docs, w):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        cover = [0] * len(b)
        for p in range(len(b) - w + 1):
            if b[p : p + w] in seen:
                cover[p : p + w] = [1] * w
            seen.add(b[p : p + w])
        kept = bytes(x for x, y in zip(b, cover) if not y)
        runs = sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdefgh é", k=r.randint(150, 600))) for _ in range(6)]
    docs = []
    for i in range(120):
        t = "".join(r.choices("xyzuvw", k=r.randint(0, 80)))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randrange(len(b))
            t += b[a : a + r.randint(1, 500)] + "".join(r.choices("klmno", k=r.randint(0, 30)))
        if i % 17 == 0:
            t = "ab" * r.randint(0, 300)
        if i % 29 == 0:
            t = "a" * r.randint(50, 400)
        docs.append((i, t if i % 23 else None))
    return docs + [(200 + i, docs[r.randrange(120)][1]) for i in range(30)]


@pytest.mark.parametrize("seed,block,hot", [(1, 1_000_000, 8_000), (2, 2_000, 3), (3, 50_000, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, block, hot):
    docs = corpus(seed)
    plain = S.repeated_spans
    monkeypatch.setattr(S, "repeated_spans", lambda d, w: plain(d, w, block, hot))
    got = S.remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute(docs, 100)


def test_long_texts_are_cut_into_steps(monkeypatch):
    monkeypatch.setattr(S, "STEP", 300)
    r = np.random.default_rng(1)
    raw = np.concatenate([r.integers(97, 100, 1500).astype(np.uint8)] * 2)
    text, p, n, *_ = S.regions(raw, np.array([0, 100, 99 + 100, len(raw)]))
    windows = sorted((int(t), q) for t, a, k in zip(text, p, n) for q in range(a, a + k))
    assert windows == [(0, 0)] + [(2, q) for q in range(len(raw) - 199 - 99)]


def test_nulls_ties_and_empty_tables(spark):
    a = "q" + "".join(chr(97 + i % 26) for i in range(150))
    df = spark.createDataFrame([(None, a), (1, a), (2, a), (2, a)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.kept) for r in S.remove_repeats(df).collect()}
    assert {x for x in got if x[0] is not None} == {(1, 151, b""), (2, 151, b"")}
    assert [x[2] + b"" for x in got if x[0] is None][0] in a.encode()
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    for _ in range(150):
        v = [r.randint(0, 2) for _ in range(r.randint(1, 50))]
        s = SuffixArray(np.array(v), len(v))
        order = s.order.tolist()
        assert order == sorted(range(len(v)), key=lambda i: v[i:])
        for k, m in enumerate(s.lcp().tolist()[1:], 1):
            a, b = v[order[k - 1] :], v[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert m == same


def test_maximal_repeats_hold_all_occurrences():
    for seed in range(120):
        r = random.Random(seed)
        base = "".join(r.choices("abc", k=60))
        strings = []
        for _ in range(6):
            a = r.randint(0, 30)
            strings.append((base[a : a + r.randint(10, 30)] + "".join(r.choices("abc", k=r.randint(0, 5)))).encode())
        starts = np.array([len(s) - 9 for s in strings])
        where = {}
        for i, s in enumerate(strings):
            for p in range(starts[i]):
                where.setdefault(s[p : p + 10], []).append((i, p))
        want = {(i, x) for v in where.values() for i, p in v if (i, p) != min(v) for x in range(p, p + 10)}
        got = set()
        for length, own, at in S.maximal_repeats(np.zeros(6, int), strings, starts, 10):
            places = sorted(zip(own.tolist(), at.tolist()))
            assert len({strings[i][p : p + length] for i, p in places}) == 1 and len(places) > 1
            got |= {(i, x) for i, p in places[1:] for x in range(p, p + length)}
        assert got == want
