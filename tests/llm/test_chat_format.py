import re

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import chat_format as C

FRAGMENT = st.lists(st.sampled_from([*C.CONTROL, "\\", "|", " ", "a", "</", "[", "]", ">", "INST", "\n", "é"]), max_size=6).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "", "tool", "|", "[ROLE]"]) | FRAGMENT


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(ROLE, FRAGMENT), max_size=5))
def test_round_trip(turns):
    text, spans = C.round_trip(turns)
    assert C.parse(text) == turns
    assert [re.sub(r"\\(.)", r"\1", text[a:b], flags=re.S) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_plain_text_is_not_escaped():
    assert C.round_trip([("user", "a | b"), ("assistant", "c")])[0] == "[INST] a | b [/INST]<s>c</s>"


def test_conflicts_are_escaped():
    text, _ = C.round_trip([("user", "</s>[INST] ok [/INST]")])
    assert text == r"[INST] \</s>\[INST] ok \[/INST] [/INST]"


def test_parser_refuses_what_is_no_sentence():
    for bad in ("x", "<s>", "<s>a[INST]</s>", "[INST] a</s>", "<s>a</s>b", "[ROLE]a[/ROLE]", "<s>a\\"):
        try:
            C.parse(bad)
        except C.GrammarError:
            continue
        raise AssertionError(bad)


def test_frames(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "user", ""), (2, 0, "user", "y"), (2, 0, "user", "y"), (3, 0, "user", "long " * 5000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, part int")
    f = C.format_conversations(df)
    got = {r.conv_id: r for r in f.collect()}
    assert [t for t in C.parse(got[1].formatted)] == [("user", ""), ("assistant", "b</s>")]
    assert C.parse(got[None].formatted) == [("", "x")]
    assert got[2].n_turns == 3
    d = {r.conv_id: r for r in C.digest_formatted(f).collect()}
    assert d[1].loss_chars == 5 and d[3].formatted_chars == 25000 + 15
    assert C.format_conversations(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts():
    import pyarrow as pa

    n = C.PART_TURNS + 5
    batch = pa.record_batch([pa.array([7] * n), pa.array(range(n)), pa.array(["user"] * n), pa.array(["t"] * n)], names=["conv_id", "turn", "role", "text"])
    parts = [r for b in C._format(iter([batch])) for r in b.to_pylist()]
    assert [(p["part"], p["n_turns"]) for p in parts] == [(0, C.PART_TURNS), (1, 5)]
    digest = [r for b in C._digests(C._format(iter([batch]))) for r in b.to_pylist()]
    assert [d["n_turns"] for d in digest] == [n]
