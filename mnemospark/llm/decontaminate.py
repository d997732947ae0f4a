"""Benchmark decontamination by a hash set of normalised benchmark n-grams.

Texts are normalised to words (A-Z lower-cased; runs of digits, letters a-z and
characters from U+0080 on). A window is ``size`` consecutive words of a
benchmark item; an item of fewer words is one window. The windows' hashes are
broadcast, every document's token windows are looked up, and each hit is
verified word by word. Documents, or only the hit spans, can then be removed.

The broadcast's size is bounded: above ``max_bytes`` of benchmark text (checked
before anything is collected) the same windows meet in a shuffle join instead.

Edge cases: a null or empty text has no words, no hits and isn't contaminated;
an item without words has no window; items that share an id are one item; hits
of an item with a null id count, but the item isn't listed; an empty benchmark
hits nothing; repeated documents are each scanned; texts are scanned whole;
clashing columns (``n_words``, ``n_hit``, ``items``, ``contaminated``,
``clean_text``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import HASH, HASH2, offsets, owner, pieces, staged, with_fields, word_windows, words_of

SIZE = 13
#: Benchmark text up to this size is broadcast (as hashes and window texts, about ten times as much).
MAX_BROADCAST_BYTES = 8 << 20
#: A document is contaminated when ``RATIO * n_hit >= n_words``.
RATIO = 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

OUTPUT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "contaminated": "boolean", "clean_text": "string"}


@dataclass
class Windows:
    """The benchmark's windows: by length, sorted hashes with a bitmap before them; by content, their items."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    bitmap: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[bytes, list[int]] = field(default_factory=dict)
    names: list[str | None] = field(default_factory=list)


def _content(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join(raw[starts[i] : ends[i]].tobytes() for i in range(at, at + size))


def build(items: list[tuple[str | None, str]], size: int = SIZE) -> Windows:
    """items: (id, text)."""
    out, place, found = Windows(), {}, {}
    for name, text in items:
        raw, starts, ends, words, _ = words_of(pa.array([text or ""]), IS_WORD)
        if not len(words):
            continue
        if name not in place:
            place[name] = len(out.names)
            out.names.append(name)
        k = min(size, len(words))
        hashes = word_windows(words, [k])[k]
        found.setdefault(k, []).append(hashes)
        for i in range(len(hashes)):
            own = out.items.setdefault(_content(raw, starts, ends, i, k), [])
            if place[name] not in own:
                own.append(place[name])
    for k, parts in found.items():
        out.hashes[k] = np.unique(np.concatenate(parts))
        out.bitmap[k] = np.zeros(1 << 20, bool)
        out.bitmap[k][out.hashes[k] >> np.uint64(44)] = True
    return out


def find(windows: Windows, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, size): where windows may occur, by their hashes."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for k, h in word_windows(words, windows.hashes).items():
        known = windows.hashes[k]
        i = np.flatnonzero(windows.bitmap[k][h >> np.uint64(44)])
        i = i[doc[i] == doc[i + k - 1]]
        j = np.minimum(np.searchsorted(known, h[i]), len(known) - 1)
        yield i[known[j] == h[i]], k


def _report(piece: pa.RecordBatch, at_text: int, hits, raw, starts, ends, at, names, clean: bool) -> list[pa.Array]:
    """Output columns. hits: (position, size, items) of verified windows."""
    n = piece.num_rows
    n_words = np.diff(at)
    edge = np.zeros(len(starts) + 1, np.int32)
    items: dict[int, set[int]] = {}
    for i, k, own in hits:
        edge[i] += 1
        edge[i + k] -= 1
        items.setdefault(int(np.searchsorted(at, i, side="right")) - 1, set()).update(own)
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[at[1:]] - total[at[:-1]]
    listed = [sorted({names[x] for x in items[d]} - {None}) if d in items else [] for d in range(n)]
    contaminated = (n_hit > 0) & (RATIO * n_hit >= n_words)
    texts = piece.column(at_text)
    if clean:
        cleaned, begun = texts.to_pylist(), offsets(texts) - offsets(texts)[0]
        for d in np.flatnonzero(n_hit):
            own = np.flatnonzero(hit[at[d] : at[d + 1]]) + at[d]
            body, base = cleaned[d].encode(), begun[d]
            keep, last = [], 0
            for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                keep.append(body[last : starts[run[0]] - base])
                last = ends[run[-1]] - base
            cleaned[d] = b"".join([*keep, body[last:]]).decode()
        texts = pa.array(cleaned, pa.string())
    else:
        texts = pa.nulls(n, pa.string())
    return [pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(listed, pa.list_(pa.string())), pa.array(contaminated), texts]


def _benchmark_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("text")).where(F.col("text").isNotNull())


@owner
def scan(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, clean: bool = False, keep_text: bool = True, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """documents(text, ...) and benchmark(item_id, text) -> documents with the columns of OUTPUT.

    clean: also return clean_text, the text without the hit spans (else null).
    keep_text: whether the text itself comes back too.
    """
    rows = _benchmark_rows(benchmark)
    bytes_ = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    kept = documents.drop(*OUTPUT)
    schema = with_fields((kept if keep_text else kept.drop("text")).schema, **OUTPUT)
    at_text = kept.columns.index("text")
    if bytes_ > max_bytes:
        found = _scan_shuffled(kept, rows, size, clean)
        return found if keep_text else found.drop("text")
    shared = documents.sparkSession.sparkContext.broadcast(build([tuple(r) for r in rows.collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece in pieces(batch, at_text):
                raw, starts, ends, words, at = words_of(piece.column(at_text), IS_WORD)
                hits = []
                for where, k in find(w, words, at):
                    for i in where:
                        if (own := w.items.get(_content(raw, starts, ends, i, k))) is not None:
                            hits.append((i, k, own))
                own = [i for i in range(piece.num_columns) if keep_text or i != at_text]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in own] + _report(piece, at_text, hits, raw, starts, ends, at, w.names, clean), names=[*(piece.schema.names[i] for i in own), *OUTPUT])

    return kept.mapInArrow(run, schema)


def _scan_shuffled(documents: DataFrame, rows: DataFrame, size: int, clean: bool) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet by a 128-bit key, then every hit is verified."""
    docs = staged(documents.withColumn("__row", F.expr("uuid()")), "decontaminate")
    at_text = docs.columns.index("text")

    def item_windows(batches):
        for batch in batches:
            out = {"k": [], "h1": [], "h2": [], "content": [], "name": []}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, starts, ends, words, _ = words_of(pa.array([text]), IS_WORD)
                if len(words):
                    k = min(size, len(words))
                    h = [word_windows(words, [k], kind)[k].view(np.int64) for kind in (HASH, HASH2)]
                    out["k"] += [k] * len(h[0])
                    out["h1"] += h[0].tolist()
                    out["h2"] += h[1].tolist()
                    out["content"] += [_content(raw, starts, ends, i, k) for i in range(len(h[0]))]
                    out["name"] += [name] * len(h[0])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("k", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("content", pa.binary()), ("name", pa.string())]))

    known = staged(rows.mapInArrow(item_windows, "k int, h1 long, h2 long, content binary, name string").groupBy("k", "h1", "h2", "content").agg(F.collect_set("name").alias("names")), "windows")
    sizes = sorted(r.k for r in known.select("k").distinct().collect())  # at most ``size`` rows

    def doc_windows(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                _, _, _, words, at = words_of(piece.column(1), IS_WORD)
                doc = np.repeat(np.arange(piece.num_rows), np.diff(at))
                ids = piece.column(0)
                windows = [word_windows(words, sizes, kind) for kind in (HASH, HASH2)]
                for k in windows[0]:
                    h = [w[k].view(np.int64) for w in windows]
                    i = np.flatnonzero(doc[: len(h[0])] == doc[k - 1 : k - 1 + len(h[0])])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[i])), pa.array((i - at[doc[i]]).astype(np.int64)), pa.array(np.full(len(i), k, np.int32)), pa.array(h[0][i]), pa.array(h[1][i])], names=["__row", "pos", "k", "h1", "h2"])

    met = docs.select("__row", "text").mapInArrow(doc_windows, "__row string, pos long, k int, h1 long, h2 long").join(known, ["k", "h1", "h2"])
    hits = met.groupBy("__row").agg(F.collect_list(F.struct("pos", "k", "content", "names")).alias("__hits"))

    def verify(batches):
        for batch in batches:
            for piece in pieces(batch, at_text):
                raw, starts, ends, words, at = words_of(piece.column(at_text), IS_WORD)
                names, place, good = [], {}, []
                for d, own in enumerate(piece.column(piece.num_columns - 1).to_pylist()):
                    for x in own or ():
                        i = int(at[d]) + x["pos"]
                        if _content(raw, starts, ends, i, x["k"]) == x["content"]:
                            for name in x["names"]:
                                if name not in place:
                                    place[name] = len(names)
                                    names.append(name)
                            good.append((i, x["k"], [place[v] for v in x["names"]]))
                yield pa.RecordBatch.from_arrays(piece.columns[:-2] + _report(piece, at_text, good, raw, starts, ends, at, names, clean), names=[*piece.schema.names[:-2], *OUTPUT])

    return docs.join(hits, "__row", "left").select(*documents.columns, "__row", "__hits").mapInArrow(verify, with_fields(documents.schema, **OUTPUT))


@owner
def remove_documents(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that aren't contaminated."""
    return scan(documents, benchmark, size).where(~F.col("contaminated")).select(*documents.columns)


@owner
def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """All documents, without the spans that occur in the benchmark."""
    found = scan(documents, benchmark, size, clean=True).withColumn("text", F.col("clean_text"))
    return found.select(*documents.columns)
