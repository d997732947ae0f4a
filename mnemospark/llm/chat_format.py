"""Chat formatting with a grammar round trip.

Every turn is rendered in the template below, the rendered text is parsed back
by a deterministic parser and the recovered turns are compared with the source.
Turns that differ are escaped and the text is rendered and parsed again, until
the recovered turns are identical.

Grammar (``raw`` is any text in which no control string begins unescaped):

    conversation := turn*
    turn := "[INST] " raw " [/INST]"          role user
          | "<s>" raw "</s>"                  role assistant
          | "<<SYS>>" raw "<</SYS>>"          role system
          | "[ROLE]" raw "|" raw "[/ROLE]"    any other role: name, then text

A backslash makes the character after it an ordinary one. Only turns that fail
the round trip are escaped, so ordinary text is rendered as it stands.

Edge cases: a null role is the empty role, a null text the empty text, a null
conv_id a conversation of its own; turns are ordered by turn (nulls first), then
role, then text, and repeated rows are kept; an empty table gives no rows; other
columns are ignored. A conversation of any length streams through its task in
parts of bounded size, each rendered and checked by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
TEMPLATE = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "|", "[/ROLE]")
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CONFLICT = re.compile(r"\\|\||" + _CONTROL.pattern)
_OPEN = re.compile("|".join(f"(?P<{k}>{re.escape(v[0])})" for k, v in TEMPLATE.items()) + f"|(?P<other>{re.escape(OTHER[0])})")
_STOP = re.compile(r"\\|" + _CONTROL.pattern)
_STOP_NAME = re.compile(r"\\|\||" + _CONTROL.pattern)

#: A part of a conversation is closed when it has this many characters or turns.
PART_CHARS, PART_TURNS = 1 << 22, 4096

SCHEMA = "conv_id long, part int, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class GrammarError(ValueError):
    """The text isn't a sentence of the template's grammar."""


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def render(turns: list[tuple[str, str]], escaped: set[int] = frozenset()) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask (assistant texts); turns in ``escaped`` are escaped."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        body = escape(text) if i in escaped else text
        if role in TEMPLATE:
            head, tail = TEMPLATE[role]
        else:
            head, tail = f"{OTHER[0]}{escape(role) if i in escaped else role}{OTHER[1]}", OTHER[2]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def _raw(text: str, at: int, stop: re.Pattern) -> tuple[str, int, int]:
    """Unescaped text from ``at``, and where the control string that ends it begins and ends."""
    got = []
    while m := stop.search(text, at):
        got.append(text[at : m.start()])
        if m[0] != "\\":
            return "".join(got), m.start(), m.end()
        if m.end() == len(text):
            raise GrammarError("escape at the end")
        got.append(text[m.end()])
        at = m.end() + 1
    raise GrammarError("turn without an end")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises GrammarError where it isn't one."""
    turns, at = [], 0
    while at < len(text):
        if not (m := _OPEN.match(text, at)):
            raise GrammarError(f"no turn begins at {at}")
        role = m.lastgroup
        at = m.end()
        if role == "other":
            role, start, at = _raw(text, at, _STOP_NAME)
            if text[start:at] != OTHER[1]:
                raise GrammarError("control string in a role")
            close = OTHER[2]
        else:
            close = TEMPLATE[role][1]
        body, start, end = _raw(text, at, _STOP)
        if close.startswith(" "):  # the user's closing string has a space before it
            if text[start:end] != close[1:] or start == at or text[start - 1] != " " or (start - at >= 2 and text[start - 2] == "\\" and not body.endswith(" ")):
                raise GrammarError("wrong end of a turn")
            body = body[:-1]
        elif text[start:end] != close:
            raise GrammarError("wrong end of a turn")
        turns.append((role, body))
        at = end
    return turns


def _turn_holds(turn: tuple[str, str]) -> bool:
    try:
        return parse(render([turn])[0]) == [turn]
    except GrammarError:
        return False


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Renders, parses and compares; escapes the turns in conflict until what is recovered is identical."""
    escaped: set[int] = set()
    while True:
        text, spans = render(turns, escaped)
        try:
            back = parse(text)
        except GrammarError:
            back = None
        if back == turns:
            return text, spans
        fresh = {i for i, t in enumerate(turns) if i not in escaped and not _turn_holds(t)}
        if not fresh:
            fresh = set(range(len(turns))) - escaped
        if not fresh:
            raise GrammarError("fully escaped turns must come back")
        escaped |= fresh


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    conv, part, turns, size, begun = None, 0, [], 0, False

    def close() -> None:
        text, spans = round_trip(turns)
        rows.append({"conv_id": conv, "part": part, "n_turns": len(turns), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

    for batch in batches:
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if begun and (c != conv or size >= PART_CHARS or len(turns) >= PART_TURNS):
                close()
                part, turns, size = (part + 1 if c == conv else 0), [], 0
            begun, conv = True, c
            turns.append((role, text))
            size += len(text)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    if begun:
        close()
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, part, n_turns, formatted, loss_spans).

    A conversation's text is its parts in order; loss_spans are code-point
    ranges of a part. Almost every conversation has one part.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, SCHEMA)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun, rows = None, False, []

    def fresh() -> None:
        nonlocal n, chars, formatted, turns, loss
        n, chars, formatted, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def close() -> None:
        rows.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})

    n = chars = formatted = 0
    turns = loss = None
    for batch in batches:
        for c, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            if not begun or c != conv:
                if begun:
                    close()
                begun, conv = True, c
                fresh()
            for role, body in parse(text):
                n += 1
                turns.update(f"{role}\n{body}\n".encode())
            for s in spans:
                body = re.sub(r"\\(.)", r"\1", text[s["start"] : s["end"]], flags=re.S) if "\\" in text[s["start"] : s["end"]] else text[s["start"] : s["end"]]
                chars += len(body)
                loss.update(body.encode())
            formatted += len(text)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)
            rows = []
    if begun:
        close()
        yield pa.RecordBatch.from_pylist(rows, _DIGEST)


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the formatted text by the parser.

    Needs the parts of a conversation together and in order, as
    ``format_conversations`` returns them.
    """
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
