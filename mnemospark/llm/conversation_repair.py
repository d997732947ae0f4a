"""Repair of the structure of conversations by cheapest edits, with a DP shared along a trie.

A conversation's rows, in order, are written as a signature: one character a
row, for its role's initial and its first fault. A repaired conversation has the
role initials ``(s?(ua)+)?``. Edits, in the letters of an audit:

    K keep      0, and 5 more for a truncated row; not for a blank or duplicate row
    R rerole    1, to user or assistant, and 5 more for a truncated row; as K
    D delete    2
    I insert    5, an empty text of user or assistant, anywhere

Signatures are sorted, so that those with a common prefix stand together: the
path of the prefix trie that the current signature takes lies on a stack of DP
layers (the least cost of every state), and the next signature goes on from the
layers of the prefix that it shares. At a terminal node the cheapest edits are
read off the layers: backwards, which states lie on a cheapest way; forwards,
the ASCII-least letter among these.

Faults, the first that holds: blank (no character but space and \\t to \\r),
duplicate (role and text seen in an earlier row of the conversation), truncated
(the last such character is not one of ``.!?``).

Edge cases: nulls in role and text are one space; a null conv_id is a
conversation of its own; rows stand by turn (nulls first), then role, then text,
and repeated rows are duplicates of the first; a conversation whose rows are all
marked as dropped, has no rows: its plan is empty; an empty table gives no rows;
other columns are ignored. Roles are told apart by their first character alone.
A conversation's rows go through one task as a stream, as its order asks for;
what is held of it is a character a row and the layers of its signature (16
bytes a row).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import staged

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Roles by initial (other: x), and faults; a row's code is 4 * role + fault.
ROLES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
#: A row's character is this one plus its code.
FIRST = ord("A")
#: Pairs of neighbouring role initials that are in order.
LEGAL = {"su", "ua", "au"}

#: States: nothing yet, after a system, after a user, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state after a user or assistant turn that is inserted or reroled (there is only one that fits).
TURN = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by state and role; -1: it doesn't fit.
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 30

ROW = "conv_id long, pos long, turn long, role string, text string, code int"


def _visible(text: str | Column) -> Column:
    """The text without white space at its end."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")


def mark(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """(conv_id, pos, turn, role, text, code): rows with their place, role and fault; code is null for rows that ``dropped``, a flag, leaves out.

    Both windows lie within one conversation, so rows move once.
    """
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "gone")
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")
    rows = rows.withColumn("pos", F.row_number().over(place).cast("long")).withColumn("nth", F.row_number().over(seen))
    end = _visible("text")
    fault = F.when(end == "", 1).when(F.col("nth") > 1, 2).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    role = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    return rows.select("conv_id", "pos", "turn", "role", "text", F.when(~F.col("gone"), 4 * role + fault).cast("int").alias("code"))


_SIGNED = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), ("gaps", pa.int64())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; a conversation may go on in the next batch."""
    done: list[tuple] = []
    conv, begun, held, low, high, turns = None, False, [], None, None, 0

    def close() -> tuple:
        return conv, b"".join(held).decode("ascii"), high - low + 1 - turns if turns else 0

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, turn, code = batch.column("conv_id"), batch.column("turn"), batch.column("code")
        ids_null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        there = code.is_valid().to_numpy(zero_copy_only=False)
        code = code.fill_null(0).to_numpy()
        timed, turn = turn.is_valid().to_numpy(zero_copy_only=False) & there, turn.fill_null(0).to_numpy()
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ids_null[1:] != ids_null[:-1]))).tolist()
        for a, b in zip(first, [*first[1:], n]):
            who = None if ids_null[a] else int(ids[a])
            if not begun or who != conv:
                if begun:
                    done.append(close())
                conv, begun, held, low, high, turns = who, True, [], None, None, 0
            held.append((code[a:b][there[a:b]] + FIRST).astype(np.uint8).tobytes())
            times = turn[a:b][timed[a:b]]
            if len(times):
                low = int(times[0]) if low is None else low
                turns += int((times[1:] != times[:-1]).sum()) + (high is None or int(times[0]) != high)
                high = int(times[-1])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _SIGNED)], schema=_SIGNED)
            done = []
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), _SIGNED)], schema=_SIGNED)


def signatures(marked: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps): gaps is the number of turns missing between the first and the last."""
    rows = marked.select("conv_id", "pos", "turn", "code")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_sign, "conv_id long, signature string, gaps long")


class Trie:
    """The path of a prefix trie that the current signature takes, as a stack of DP layers and counts."""

    def __init__(self) -> None:
        self.path = ""
        self.cost = array("i", _inserted([0, FAR, FAR, FAR]))  # four a layer
        self.counts = array("q", [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
        self.layers = 0  # made so far

    def go_to(self, signature: str) -> None:
        """Back to the prefix that is shared with the signature, and on to its end."""
        common = shared_prefix(self.path, signature)
        del self.cost[4 * (common + 1) :]
        del self.counts[4 * (common + 1) :]
        for i in range(common, len(signature)):
            self.cost.extend(_next(self.cost[-4:], ord(signature[i]) - FIRST))
            counts = self.counts[-4:]
            role, fault = divmod(ord(signature[i]) - FIRST, 4)
            if fault:
                counts[fault - 1] += 1
            if i and ROLES[(ord(signature[i - 1]) - FIRST) // 4] + ROLES[role] not in LEGAL:
                counts[3] += 1
            self.counts.extend(counts)
            self.layers += 1
        self.path = signature

    def answer(self) -> tuple[int, str]:
        """(cost, audit) of the current signature."""
        n = len(self.path)
        ways = bytearray(4 * (n + 1))  # for each layer and state: 1 if it lies on a cheapest way
        best = min(self.cost[4 * n + s] for s in ENDS)
        for s in ENDS:
            ways[4 * n + s] = self.cost[4 * n + s] == best
        for i in range(n, -1, -1):
            for _ in range(2):  # two inserts at most follow one another on a cheapest way
                for s in range(4):
                    ways[4 * i + s] |= ways[4 * i + TURN[s]] and self.cost[4 * i + s] + INSERT == self.cost[4 * i + TURN[s]]
            if i:
                code = ord(self.path[i - 1]) - FIRST
                for s in range(4):
                    here = self.cost[4 * (i - 1) + s]
                    ways[4 * (i - 1) + s] = any(ways[4 * i + t] and here + c == self.cost[4 * i + t] for _, t, c in _steps(s, code))
        letters, i, s = [], 0, START
        while True:
            here, options = self.cost[4 * i + s], []
            if i < n:
                options = [(e, i + 1, t) for e, t, c in _steps(s, ord(self.path[i]) - FIRST) if ways[4 * (i + 1) + t] and here + c == self.cost[4 * (i + 1) + t]]
            if ways[4 * i + TURN[s]] and here + INSERT == self.cost[4 * i + TURN[s]]:
                options.append(("I", i, TURN[s]))
            if not options:
                return best, "".join(letters)
            letter, i, s = min(options)
            letters.append(letter)


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _steps(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of what can be done with a row."""
    role, fault = divmod(code, 4)
    out = [("D", state, DELETE)]
    if fault not in (1, 2):
        more = TRUNCATED * (fault == 3)
        if KEPT[state][role] >= 0:
            out.append(("K", KEPT[state][role], more))
        out.append(("R", TURN[state], REROLE + more))
    return out


#: The same as tables.
STEPS = [[_steps(s, c) for s in range(4)] for c in range(16)]


def _inserted(cost: list[int]) -> list[int]:
    """A layer after inserts."""
    for _ in range(2):
        for s in range(4):
            cost[TURN[s]] = min(cost[TURN[s]], cost[s] + INSERT)
    return cost


def _next(cost: array, code: int) -> list[int]:
    out = [FAR] * 4
    for s in range(4):
        if cost[s] < FAR:
            for _, t, c in STEPS[code][s]:
                out[t] = min(out[t], cost[s] + c)
    return _inserted(out)


_PLAN = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted signatures in, one plan a row out."""
    trie, last, known = Trie(), None, ()
    for batch in batches:
        rows = []
        for conv, signature, gaps in zip(*(c.to_pylist() for c in batch.columns)):
            if signature != last:
                trie.go_to(signature)
                last, known = signature, (*trie.counts[-4:], *trie.answer())
            rows.append((conv, gaps, *known))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PLAN)], schema=_PLAN)


def plan_repairs(signed: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    Ranges are cut by the beginning of the signature and by conv_id, so a
    signature that many conversations share is dealt to many tasks.
    """
    dealt = signed.withColumn("__begin", F.substring("signature", 1, 64)).repartitionByRange("__begin", "conv_id").sortWithinPartitions("signature")
    return dealt.select("conv_id", "signature", "gaps").mapInArrow(_answers, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class Walk:
    """A conversation's audit, applied row after row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = TURN[self.state]
            yield NAMES[self.state], ""

    def row(self, role: str, text: str, code: int) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][code // 4]
            yield role, text
        elif letter == "R":
            self.state = TURN[self.state]
            yield NAMES[self.state], text


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, walk, pos, out = None, None, 0, []
    for batch in batches:
        for who, place, role, text, code in zip(*(c.to_pylist() for c in batch.columns)):
            if not place:  # the audit comes before the conversation's rows
                if walk is not None:
                    out += ((conv, pos + k, *turn) for k, turn in enumerate(walk.inserts()))
                conv, walk, pos = who, Walk(text), 0
            elif code is not None:
                for turn in walk.row(role, text, code):
                    out.append((conv, pos, *turn))
                    pos += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _REPAIRED)], schema=_REPAIRED)
            out = []
    if walk is not None and (out := [(conv, pos + k, *turn) for k, turn in enumerate(walk.inserts())]):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _REPAIRED)], schema=_REPAIRED)


def apply_repairs(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the repaired conversations, each in one partition and in order.

    An audit goes in front of its conversation's rows once, so a long one isn't
    repeated for every row.
    """
    heads = plans.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("int").alias("code"))
    rows = heads.unionByName(marked.select("conv_id", "pos", "role", "text", "code"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_repair, "conv_id long, pos long, role string, text string")


_HASHED = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha, out = None, None, []
    for batch in batches:
        for who, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not pos:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = who, hashlib.sha256()
            sha.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _HASHED)], schema=_HASHED)
            out = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, sha.hexdigest()), _HASHED)], schema=_HASHED)


def digest_repaired(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of role:text, joined by newlines; needs a conversation's rows together and in order, as ``apply_repairs`` returns them."""
    return repaired.mapInArrow(_digest, "conv_id long, sha256 string")


def repair(conversations: DataFrame, dropped: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired conversations); see ``plan_repairs`` and ``apply_repairs``."""
    marked = staged(mark(conversations, dropped), "turns")
    plans = staged(plan_repairs(signatures(marked)), "repairs")
    return plans, apply_repairs(marked, plans)
