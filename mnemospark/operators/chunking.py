"""Chunkers and extractive summaries: ordered folds over sentences, as Arrow batch functions.

Edge cases, for all of them: a null or empty text, or one of white space, has no
sentence and so no chunk (its summary is empty); a sentence longer than a chunk
is a chunk of its own; texts are read whole, however long; repeated rows are
each cut, and a null id stays null; of sentences that score alike the first is
taken; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_END = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])")


def split(text: str) -> list[str]:
    return [s.strip() for s in _END.split(text or "") if s.strip()]


def packed(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing of sentences of these sizes into ranges first..end.

    A chunk closes before it would exceed ``most`` characters; the next one
    repeats its last ``overlap`` sentences.
    """
    out: list[tuple[int, int]] = []
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n + 1 > most:
            out.append((first, i))
            first = max(first, i - overlap)
            held = sum(x + 1 for x in sizes[first:i])
        held += n + 1
    return [*out, (first, len(sizes))] if sizes else out


def pack(sentences: list[str], most: int, overlap: int) -> list[list[str]]:
    return [sentences[a:b] for a, b in packed(list(map(len, sentences)), most, overlap)]


def chunked(df: DataFrame, most: int = 500, overlap: int = 1) -> DataFrame:
    """df(id, text) -> (id, chunk, n_sentences, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, len(c), " ".join(c)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, c in enumerate(pack(split(t), most, overlap))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["id", "chunk", "n_sentences", "text"])

    return df.select("id", "text").mapInArrow(run, "id long, chunk int, n_sentences int, text string")


def summary(text: str, most: int) -> str:
    """Sentences by score (early, of middling length, with frequent words), as many as fit, in their order."""
    sents = split(text)
    count: dict[str, int] = {}
    for s in sents:
        for w in s.lower().split():
            if len(w) > 4:
                count[w] = count.get(w, 0) + 1
    scored = sorted(range(len(sents)), key=lambda i: (-(1 / (1 + i) + min(len(sents[i]), 200) / 400 + sum(count.get(w, 0) for w in sents[i].lower().split()) / (10 * (1 + len(sents[i].split())))), i))
    chosen, size = [], 0
    for i in scored:
        if size + len(sents[i]) + 1 <= most:
            chosen.append(i)
            size += len(sents[i]) + 1
    return " ".join(sents[i] for i in sorted(chosen))


def summaries(df: DataFrame, most: int) -> DataFrame:
    """df(id, text) -> (id, summary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([summary(t, most) for t in b.column(1).to_pylist()], pa.string())], names=["id", "summary"])

    return df.select("id", "text").mapInArrow(run, "id long, summary string")


def shifts(sentences: list[str], least: float) -> list[list[str]]:
    """Groups of sentences: a new one begins where a sentence shares too few words with the one before."""
    out: list[list[str]] = []
    before: set[str] = set()
    for s in sentences:
        words = set(s.lower().split())
        both = len(words | before)
        if not out or not both or len(words & before) / both < least:
            out.append([])
        out[-1].append(s)
        before = words
    return out


def merged(groups: list[list[str]], most: int) -> list[list[str]]:
    """Neighbouring groups from left to right, joined while they fit."""
    out: list[list[str]] = []
    for g in groups:
        if out and sum(len(s) + 1 for s in [*out[-1], *g]) <= most:
            out[-1] = [*out[-1], *g]
        else:
            out.append(g)
    return out


def semantic(df: DataFrame, most: int, least: float) -> DataFrame:
    """df(id, text) -> (id, chunk, text): topic shifts, then small neighbours merged, then packing of what is too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [c for g in merged(shifts(split(t), least), most) for c in pack(g, most, 0)]
                rows += [(i, k, " ".join(c)) for k, c in enumerate(parts)]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["id", "chunk", "text"])

    return df.select("id", "text").mapInArrow(run, "id long, chunk int, text string")


def located(df: DataFrame, most: int, overlap: int) -> DataFrame:
    """df(id, text) -> (id, chunk, start, end): packed sentences with their places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans, at = [], 0
                for s in split(t):
                    at = t.index(s, at)
                    spans.append((at, at + len(s)))
                    at += len(s)
                rows += [(i, k, spans[x][0], spans[y - 1][1]) for k, (x, y) in enumerate(packed([y - x for x, y in spans], most, overlap))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["id", "chunk", "start", "end"])

    return df.select("id", "text").mapInArrow(run, "id long, chunk int, start long, end long")
