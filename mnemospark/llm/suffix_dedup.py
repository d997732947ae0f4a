"""Removal of repeated byte strings with enhanced suffix arrays.

A byte is removed when a string of ``width`` bytes that covers it also starts
earlier: in a document with a smaller id, or before in the same document. Strings
are judged on the input, and none crosses documents.

1. Anchors. Every window of ``width`` bytes picks the smallest hash among its
   GRAM-byte grams; equal windows pick the same gram. Consecutive windows with
   one anchor are a region. Regions, about one for 35 bytes, are dealt out by
   their anchor's hash, after equal ones of a batch were reduced to the first.
2. Regions equal to an earlier one are repeats as a whole. Regions that share an
   anchor, but differ, have to be searched.
3. Those regions' texts are concatenated, group after group, and suffix-sorted.
   A stack scan over the LCP values walks the tree of common-prefix intervals;
   intervals whose occurrences differ on the left are maximal repeats, reported
   with all their occurrences. All but the first occurrence are covered.
4. An anchor with more than HOT_REGIONS different regions is not searched in one
   task: its regions are salted over several, their windows are hashed (128
   bits) and reduced to the first, in the task and then by a pre-aggregated
   minimum.
5. Covered spans of a document are merged and cut out.

Edge cases: null and empty texts, and texts shorter than ``width``, lose
nothing; a null id is smaller than all others; rows with the same id and text
don't remove each other's bytes (neither starts earlier); an empty table gives
no rows; other columns are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import HASH, HASH2, flat_bytes, group_runs, mix, owner, pieces, span_hashes, staged, window_hashes
from mnemospark.llm._suffix import SuffixArray, intervals, left_diverse

WIDTH, GRAM = 100, 32
#: Suffixes that are sorted at once, and different regions of one anchor that are searched in one task.
BLOCK_SUFFIXES, HOT_REGIONS = 1_000_000, 8_000
#: Window starts handled at once (positions must fit 24 bits).
STEP = 4 << 20
#: Symbols of nine bits in a 64-bit word.
UNIT = 7
NO_ID = -(1 << 63)


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(raw: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor hash, content hash) of each region of the texts."""
    out = []
    at = 0
    while at + width <= len(raw):
        end = min(len(raw), at + STEP + width - 1)
        part = raw[at:end]
        start = np.arange(len(part) - GRAM + 1)
        gram = window_hashes(part, GRAM, HASH)[0]
        least = sliding_minimum((gram >> np.uint64(24) << np.uint64(24)) | start.astype(np.uint64), width - GRAM + 1)
        text = np.searchsorted(off, np.arange(at, at + len(least)), side="right") - 1
        inside = np.arange(at, at + len(least)) + width <= off[text + 1]
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        p = np.flatnonzero(inside)
        if len(p):
            new = np.ones(len(p), bool)
            new[1:] = (anchor[p[1:]] != anchor[p[:-1]]) | (p[1:] != p[:-1] + 1) | (text[p[1:]] != text[p[:-1]])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(p)))
            p = p[first]
            content = span_hashes(part, p, p + n + width - 1, HASH2)[0]
            shape = ((anchor[p] - p) * 4096 + n).astype(np.uint64)
            out.append((text[p], p + at - off[text[p]], n, gram[anchor[p]], mix(content ^ mix(shape))))
        at += STEP
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(map(np.concatenate, zip(*out)))


_REGION = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("p", pa.int64()), ("n", pa.int32())])
_REGION_SQL = "anchor long, content long, doc long, p long, n int"


def _regions(width: int):
    """Texts -> regions; those equal to an earlier one of the same piece come without an anchor: settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                raw, off = flat_bytes(piece.column(1))
                text, p, n, anchor, content = regions(raw, off, width)
                doc = piece.column(0).to_numpy()[text]
                order = np.lexsort((p, doc, content, anchor))
                doc, p, n, anchor, content = (x[order] for x in (doc, p, n, anchor, content))
                first = group_runs([anchor, content]) if len(doc) else np.zeros(0, bool)
                head = np.flatnonzero(first)
                head = np.repeat(head, np.diff(np.append(head, len(first))))
                same = ~first & ~((doc == doc[head]) & (p == p[head]))
                keep = np.flatnonzero(first)
                for rows, known in ((keep, True), (np.flatnonzero(same), False)):
                    a, c = (pa.array(x[rows].view(np.int64)) if known else pa.nulls(len(rows), pa.int64()) for x in (anchor, content))
                    yield pa.record_batch([a, c, pa.array(doc[rows]), pa.array(p[rows]), pa.array(n[rows].astype(np.int32))], schema=_REGION)

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions sorted by (anchor, content, doc, p) -> settled repeats (without anchor) and the first of each content where an anchor has several."""
    carry = None  # the last group: its anchor and content, the first region's place, the region not yet reported

    for batch in batches:
        done = batch.filter(batch.column(0).is_null())
        if done.num_rows:
            yield done
        batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        anchor, content, doc, p, n = (batch.column(i).to_numpy() for i in range(5))
        told = 0
        if carry is not None:
            anchor, content, doc, p, n = (np.concatenate([[x], y]) for x, y in zip(carry[0], (anchor, content, doc, p, n)))
            told = carry[1]
        group, fresh = group_runs([anchor]), group_runs([anchor, content])
        head = np.flatnonzero(fresh)
        head_of = np.repeat(head, np.diff(np.append(head, len(anchor))))
        later = ~fresh & ~((doc == doc[head_of]) & (p == p[head_of]))
        begin = np.flatnonzero(group)
        kinds = np.add.reduceat(fresh.astype(np.int64), begin)
        kinds[0] += told  # the carried region was reported: its group has several contents
        several = np.repeat(kinds > 1, np.diff(np.append(begin, len(anchor))))
        report = fresh & several
        if told:
            report[0] = False
        for rows, known in ((np.flatnonzero(report), True), (np.flatnonzero(later), False)):
            a, c = (pa.array(x[rows]) if known else pa.nulls(len(rows), pa.int64()) for x in (anchor, content))
            yield pa.record_batch([a, c, pa.array(doc[rows]), pa.array(p[rows]), pa.array(n[rows].astype(np.int32))], schema=_REGION)
        last = head[-1]
        carry = (anchor[last], content[last], doc[last], p[last], n[last]), int(several[last])


_TEXTED = pa.schema([*_REGION, ("salt", pa.int64()), ("bytes", pa.binary())])


def _texts(width: int):
    """(doc, text, regions) -> regions with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                rows = {k: [] for k in _TEXTED.names}
                for doc, text, wanted in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    raw = text.encode()
                    for r in wanted:
                        got = raw[r["p"] : r["p"] + r["n"] + width - 1]
                        if len(got) == r["n"] + width - 1:
                            for k, v in zip(_TEXTED.names, (r["anchor"], r["content"], doc, r["p"], r["n"], r["salt"], got)):
                                rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, _TEXTED)

    return run


def maximal_repeats(group: np.ndarray, strings: list[bytes], starts: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats among strings: (length, string of each occurrence, place in it).

    Only the first starts[i] places of string i count, each followed by width
    bytes at least; strings of different groups aren't compared. Repeats shorter
    than width are left out, and occurrences come with all others of their repeat.
    """
    # Every string ends in a 0 below all bytes (1 to 256), so that of equal suffixes the shortest come first.
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    begin = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()) + UNIT, np.uint16)
    inside = np.ones(len(raw), bool)
    inside[begin + size - 1] = False
    inside[len(raw) - UNIT :] = False
    raw[inside] = np.frombuffer(b"".join(strings), np.uint8)
    raw[inside] += 1
    word = np.zeros(len(raw) - UNIT, np.uint64)
    for k in range(UNIT):
        word = (word << np.uint64(9)) | raw[k : k + len(word)]
    owner = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(word)) - begin[owner]
    array = SuffixArray(word, 2 * width, unit=UNIT)
    usable = (place < starts[owner])[array.order]
    order = array.order[usable]
    # Common prefixes of usable neighbours: those of the whole array would pass over the rest.
    array.order = order
    lcp = array.lcp()
    if len(order) > 1:
        a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
        on = np.ones(len(a), bool)
        for _ in range(UNIT):  # within the last word
            on &= (a < len(word)) & (b < len(word))
            on[on] = raw[a[on]] == raw[b[on]]
            lcp[1:] += on
            a, b = a + on, b + on
        left = begin[owner[order]] + size[owner[order]] - 1 - order
        lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
        lcp[1:][group[owner[order[1:]]] != group[owner[order[:-1]]]] = 0
    before = np.where(place[order] > 0, raw[np.maximum(order - 1, 0)].astype(np.int64), -1)
    high = lcp >= width
    if not high.any():
        return
    # Runs of neighbours with a common prefix of width bytes: intervals at the top of the tree.
    run_begin = np.flatnonzero(high & ~np.concatenate([[False], high[:-1]])) - 1
    run_end = np.flatnonzero(high & ~np.concatenate([high[1:], [False]]))
    edges = np.stack([run_begin, run_end + 1], axis=1).ravel()
    lowest, highest = (f.reduceat(np.append(before, 0), edges)[::2] for f in (np.minimum, np.maximum))
    diverse = (lowest != highest) | (lowest < 0)
    for a, b in zip(run_begin[diverse].tolist(), run_end[diverse].tolist()):
        own = lcp[a : b + 1].copy()
        own[0] = 0
        for left, right, length in intervals(own, width):
            if left_diverse(before[a + left : a + right + 1]):
                at = order[a + left : a + right + 1]
                yield length, owner[at], place[at]


_SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])


def _search(width: int, block: int):
    """Regions with bytes, sorted by anchor -> spans covered by later occurrences; hashed windows (w1, w2) of hot anchors (salt >= 0)."""

    def spans(rows: list[tuple], at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """Covered pieces, given as places among the regions' bytes, as maximal spans of each region."""
        size = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))
        begin = np.cumsum(size) - size
        edge = np.zeros(int(size.sum()) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        on = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        step = np.flatnonzero(on[1:] != on[:-1])
        first, last = step[::2], step[1::2]
        # A run of covered bytes may go on in the next region: cut it there.
        own = np.searchsorted(begin, first, side="right") - 1
        until = np.searchsorted(begin, last - 1, side="right") - 1
        k = until - own + 1
        region = np.repeat(own, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        first, last = np.maximum(np.repeat(first, k), begin[region]), np.minimum(np.repeat(last, k), begin[region] + size[region])
        doc, p = np.fromiter((r[1] for r in rows), np.int64, len(rows)), np.fromiter((r[2] for r in rows), np.int64, len(rows))
        none = pa.nulls(len(region), pa.int64())
        return pa.record_batch([pa.array(doc[region]), pa.array(p[region] + first - begin[region]), pa.array(last - first), none, none], schema=_SPAN)

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        anchors, docs, ps, ns, strings = zip(*rows)
        doc, p = np.array(docs), np.array(ps)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        begin = np.cumsum(size) - size
        _, group = np.unique(np.array(anchors), return_inverse=True)
        places, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, own, at in maximal_repeats(group, list(strings), np.array(ns), width):
            d, s = doc[own], p[own] + at
            k = np.lexsort((s, d))[0]
            later = (d != d[k]) | (s != s[k])
            places.append((begin[own] + at)[later])
            lengths.append(np.full(len(places[-1]), length))
        return spans(rows, np.concatenate(places), np.concatenate(lengths))

    def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of equal windows of these regions the first is to be compared with others' by its hash; the later ones are covered."""
        if not rows:
            return
        raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        size = np.array([len(r[4]) for r in rows])
        n = np.array([r[3] for r in rows])
        own = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size)[own] + inner
        h1, h2 = (h[at] for h in window_hashes(raw, width, HASH, HASH2))
        doc, p = np.array([r[1] for r in rows])[own], np.array([r[2] for r in rows])[own] + inner
        order = np.lexsort((p, doc, h2, h1))
        h1, h2, doc, p, at = (x[order] for x in (h1, h2, doc, p, at))
        first = group_runs([h1, h2])
        head = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(first))))
        later = ~first & ((doc != doc[head]) | (p != p[head]))
        yield spans(rows, at[later], np.full(int(later.sum()), width))
        f = np.flatnonzero(first)
        yield pa.record_batch([pa.array(doc[f]), pa.array(p[f]), pa.array(np.full(len(f), width)), pa.array(h1[f].view(np.int64)), pa.array(h2[f].view(np.int64))], schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        loose: list[tuple] = []  # of hot anchors
        size = loose_size = 0
        last = None
        for batch in batches:
            for anchor, doc, p, n, salt, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "p", "n", "salt", "bytes"))):
                row = anchor, doc, p, n, raw
                if salt >= 0:
                    loose.append(row)
                    loose_size += len(raw)
                    if loose_size > block:
                        yield from windows(loose)
                        loose, loose_size = [], 0
                    continue
                if anchor != last and size > block:  # whole groups only
                    yield covered(held)
                    held, size = [], 0
                last = anchor
                held.append(row)
                size += len(raw)
        yield from windows(loose)
        if held:
            yield covered(held)

    return run


@owner
def repeated_spans(documents: DataFrame, width: int = WIDTH, block: int = BLOCK_SUFFIXES, hot: int = HOT_REGIONS) -> DataFrame:
    """documents(doc_id, text) -> (doc, start, length): covered byte spans, which may overlap."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= width)
    found = rows.mapInArrow(_regions(width), _REGION_SQL)
    judged = staged(found.repartition(F.coalesce("anchor", F.xxhash64("doc", "p"))).sortWithinPartitions("anchor", "content", "doc", "p").mapInArrow(_judge, _REGION_SQL), "regions")
    settled = judged.where("anchor is null").select("doc", F.col("p").alias("start"), (F.col("n") + width - 1).cast("long").alias("length"))
    several = judged.where("anchor is not null")
    crowded = several.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot)
    salt = F.coalesce(F.pmod(F.xxhash64("doc", "p"), F.ceil(F.col("m") / max(1, hot))), F.lit(-1)).alias("salt")
    several = several.join(crowded, "anchor", "left").select("doc", "anchor", "content", "p", "n", salt)
    wanted = several.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "p", "n", "salt")).alias("regions"))
    texted = rows.join(wanted, "doc").select("doc", "text", "regions").mapInArrow(_texts(width), _REGION_SQL + ", salt long, bytes binary")
    searched = staged(texted.repartition("anchor", "salt").sortWithinPartitions("anchor", "doc", "p").mapInArrow(_search(width, block), "doc long, start long, length long, w1 long, w2 long"), "repeats")
    exact = searched.where("w1 is null").select("doc", "start", "length")
    windows = searched.where("w1 is not null")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    later = windows.join(first, ["w1", "w2"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "length")
    return settled.unionByName(exact).unionByName(later)


_CUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["length"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@owner
def remove_repeats(documents: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and kept, the bytes left, if ``texts``."""
    spans = repeated_spans(documents, width).groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in _CUT.items()) + (", kept binary" if texts else "")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                rows = []
                for doc, text, own in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    raw = text.encode()
                    runs = merged(own or [])
                    keep, at = [], 0
                    for a, b in runs:
                        keep.append(raw[at:a])
                        at = b
                    kept = b"".join([*keep, raw[at:]]) if runs else raw
                    rows.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", *_CUT, *["kept"] * texts])

    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
