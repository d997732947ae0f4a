"""Fill-in-the-middle: texts cut in three at unit boundaries and reordered with sentinels.

One Aho-Corasick automaton finds, in a single scan, the ASCII characters that
change a unit's class (a newline for lines, white space for words, none for
characters) and the sentinels. Between two such events lies a gap of one class,
whose units follow by arithmetic: a gap is part of one line or word, or as many
characters as it is long. So only the events are kept, and the place of the k-th
boundary is looked up among them.

Where a text is cut follows from a hash of its id, so a run can be repeated on
any number of executors.

Edge cases: null texts count as empty; empty texts and texts that hold a
sentinel stay as they are (form ``plain``); a null id is hashed as the empty
string; rows with equal ids are cut by the same numbers; an empty table gives no
rows; clashing columns (``n_units``, ``form``, ``prefix_chars``,
``middle_chars``, ``output``) are replaced, others pass through. Lengths are in
code points. A text of any length is one row's work: its text and its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import pieces, with_fields

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The ASCII characters that change the class, by kind of unit.
CHANGES = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
#: Hexadecimal digits of the id's hash, and columns made of the text.
DIGITS = 8
MADE = {"n_units": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels that could be read anew across their ends."""
    if not all(sentinels) or len(set(sentinels)) < 3 or any(set(s) & {*CHANGES["word"]} for s in sentinels):
        raise ValueError("sentinels must be three different strings without white space")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} and {b!r} overlap")


def automaton(unit: str, sentinels: tuple[str, str, str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


class Units:
    """Boundaries of a text's units: the ends of units that an event closes, and arithmetic for the rest."""

    def __init__(self, text: str, unit: str, events: ahocorasick.Automaton):
        self.size, self.each = len(text), unit == "char"
        self.sentinel, ends = False, []
        for at, kind in events.iter(text):
            if kind:
                self.sentinel = True
            elif unit == "word" and ends and ends[-1] == at:  # no gap: the white space goes on
                ends[-1] = at + 1
            else:
                ends.append(at + 1)
        self.ends = ends
        closed = ends[-1] if ends else 0
        self.n = self.size if self.each else len(ends) + (self.size > closed)

    def at(self, k: int) -> int:
        """Where the first k units end."""
        if self.each:
            return k
        return 0 if not k else self.ends[k - 1] if k <= len(self.ends) else self.size


def cut(text: str, numbers: tuple[int, int, int, int], unit: str, events: ahocorasick.Automaton, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output)."""
    units = Units(text, unit, events)
    h1, h2, h3, h4 = numbers
    if not text or units.sentinel or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    a, b = sorted((units.at(h1 % (units.n + 1)), units.at(h2 % (units.n + 1))))
    p, s, m = sentinels
    if h4 % 100 < spm:
        return units.n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return units.n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def transform(documents: DataFrame, id_column: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), keep_text: bool = True) -> DataFrame:
    """Adds n_units, form (plain, psm, spm), prefix_chars, middle_chars and output, the reordered text.

    unit: line, word (with the white space after it) or char. rate: of a hundred
    texts, so many are cut; spm: of a hundred of these, so many begin with the
    suffix.
    """
    check_sentinels(sentinels)
    if unit not in CHANGES:
        raise ValueError(f"no unit {unit!r}")
    columns = [c for c in documents.columns if c not in MADE and c != text]
    kept = documents.select(*columns, F.coalesce(text, F.lit("")).alias(text), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256).alias("__hash"))
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton(unit, sentinels)
        for batch in batches:
            for piece in pieces(batch, n):
                texts, hashes = piece.column(n).to_pylist(), piece.column(n + 1).to_pylist()
                numbers = (tuple(int(h[k : k + DIGITS], 16) for k in range(0, 4 * DIGITS, DIGITS)) for h in hashes)
                made = zip(*(cut(t, h, unit, events, rate, spm, sentinels) for t, h in zip(texts, numbers)))
                arrays = [pa.array(x, pa.string() if k in ("form", "output") else pa.int64()) for k, x in zip(MADE, made)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: n + keep_text], *arrays], names=names)

    full = with_fields(kept.select(*columns, *[text] * keep_text).schema, **MADE)
    names = full.fieldNames()
    return kept.mapInArrow(run, full)


def restored(form: str = "form", output: str = "output", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text, rebuilt from form and output."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    turn = lambda *places: F.concat(*(F.try_element_at(parts, F.lit(i)) for i in places))  # noqa: E731  the first part lies before the first sentinel
    return F.when(F.col(form) == "psm", turn(2, 4, 3)).when(F.col(form) == "spm", turn(3, 4, 2)).otherwise(F.col(output))
