"""Repair of conversations against a best-first search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from mnemospark.llm import conversation_repair as C
from mnemospark.llm import queries as Q

GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows):
    """(cost, audit, turns) by a search that takes the cheapest, then ASCII-least way first; knows the grammar by its expression alone."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        if i == len(rows) and GOOD.match(roles):
            return cost, audit, list(turns)
        key = i, roles[-1:], len(roles) > 0
        if key in done or not re.match(r"(s?(ua)*u?)?\Z", roles):
            continue
        done.add(key)
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r[0], (*turns, (r, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, turns))
            if found[i] not in ("blank", "duplicate"):
                more = 5 * (found[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (role[:1] or " "), (*turns, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + r[0], (*turns, (r, text))))
    raise AssertionError("no way")


def summary(rows):
    """rows: (turn, role, text) in order."""
    texts = [r[1:] for r in rows]
    found = faults(texts)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, _ in texts]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, kept = best_edits(texts)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha


def spoiled(rows):
    """The contract's damage in plain Python; rows: (conv_id, turn, role, text)."""
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    for conv, turn, role, text in order:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def columns(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit


def test_query_equals_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.op11_conversation_repair(spark, sf_dir).collect()
    want = {c: summary(x) for c, x in spoiled(rows).items()}
    assert {r.conv_id: (*columns(r), r.repaired_sha256) for r in got} == want and len(got) == len(want)


def test_nulls_ties_and_other_columns(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for conv in [None, *range(300)]:
        for turn in r.sample(range(12), r.randrange(7)):
            rows.append((conv, r.choice([turn, turn, turn, None]) if not any(x[0] == conv and x[1] is None for x in rows) else turn, r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), r.choice(["a.", "b", "c!", "", "  \n", None, "d?", "e. \t", "fé", "g　"])))
    spark.createDataFrame([(*x, k, "z") for k, x in enumerate(rows)], "conv_id long, turn long, role string, text string, pos long, gone string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.op11_conversation_repair(spark, str(tmp_path)).collect()
    want = {c: summary(x) for c, x in spoiled(rows).items()}
    assert {x.conv_id: (*columns(x), x.repaired_sha256) for x in got} == want and len(got) == len(want)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be short."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 4, "user", "And"), (2, 0, "tool", "x."), (3, 0, "user", " ")]
    plans, repaired = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plans = {r.conv_id: r for r in plans.collect()}
    back = sorted(map(tuple, repaired.collect()))
    for conv, of in itertools.groupby(rows, key=lambda x: x[0]):
        cost, audit, turns = best_edits([x[2:] for x in of])
        assert (plans[conv].cost, plans[conv].audit) == (cost, audit)
        assert [x[2:] for x in back if x[0] == conv] == turns
    assert plans[1].gaps == 1 and plans[3].blank == 1
    none = C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [x.count() for x in none] == [0, 0]


def test_layers_are_shared():
    trie, made = C.Trie(), 0
    words = sorted({"".join(random.Random(k).choice("ABDEFHIJLM") for _ in range(random.Random(-k).randrange(9))) for k in range(400)})
    nodes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    for w in words:
        trie.go_to(w)
        alone = C.Trie()
        alone.go_to(w)
        assert trie.answer() == alone.answer() and trie.counts[-4:] == alone.counts[-4:]
        made += alone.layers
    assert trie.layers == len(nodes) < made


@pytest.mark.parametrize("n", [2, 60_000])
def test_long_conversations(n):
    trie = C.Trie()
    trie.go_to("EI" * n)  # user, assistant
    assert trie.answer() == (0, "KK" * n)
    trie.go_to("EI" * n + "E")
    assert trie.answer() == (2, "KK" * n + "D")


def test_all_short_signatures():
    rows = {"A": ("system", "x."), "E": ("user", "x."), "I": ("assistant", "x."), "M": ("tool", "x."), "H": ("user", "x"), "L": ("assistant", "x"), "F": ("user", "")}
    trie = C.Trie()
    for w in sorted("".join(w) for n in range(5) for w in itertools.product(rows, repeat=n)):
        made = [(rows[c][0], rows[c][1].replace("x", f"x{k}")) for k, c in enumerate(w)]
        trie.go_to(w)
        assert trie.answer() == best_edits(made)[:2], w
