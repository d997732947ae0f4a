"""Exact Jaccard join on word n-grams, with signature trees.

1. Documents with the same n-gram set are one node (128-bit set hash).
2. Candidates: similar sets differ in at most H n-grams, H known from the sizes.
   n-grams are dealt into 1.5 H buckets and more by hash, so similar sets agree
   on the whole content of half of H buckets at least, and on one of the
   fullest. Nodes that share a full bucket's content are joined to stars;
   connected stars are candidate groups. No similar pair is lost, and documents
   that only share a passage hardly ever agree on such a bucket. Some do, and
   the more texts, the more such chance meetings chain groups to a large one:
   groups above a bound are dealt into other buckets, among themselves, and
   fall apart where chance alone held them. What is similar meets in each deal.
3. In each candidate group a signature tree is built: its leaves hold documents
   sorted by size, its inner nodes the OR of their bitmaps and their range of
   sizes. A dual traversal prunes node pairs by the largest overlap possible
   and pairs whose documents are already linked to each other; what is left is
   compared exactly. Groups above a bound are cut into blocks that are searched
   by themselves, and classes of a family are merged by their first members. A
   link that is still missing has an end outside the group's largest class: what
   is outside is compared with all of the group, block by block, where that is
   less than every block with every other. So none is lost, and a family of near
   copies costs what it holds, not its square.
4. Components of the links give every document its class.

Edge cases: null and empty texts have no n-gram and are linked with nothing;
texts of fewer words than n are one n-gram, all their words; repeated rows are
one node; rows with a null id get the class of their text's other rows, if any;
an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import chained, dropped, flat_bytes, group_runs, mix, owner, pieces, staged, words_of
from mnemospark.llm._components import components

#: White space is U+0020 and U+0009 to U+000D.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[9, 10, 11, 12, 13, 32]] = False
#: n-grams that one task compares; larger candidate groups are cut into blocks of half as many.
BLOCK_NGRAMS = 1_000_000
#: Further deals of the buckets of large groups, as long as a deal leaves at most DEAL_SHARE of their n-grams in large groups.
DEALS, DEAL_SHARE = 8, 0.9
BITS, LEAF, FAN = 2048, 32, 8
#: Sizes of a level lie within this ratio (before partners are counted); buckets left out, in parts of the differences allowed.
RATIO, SPARE = 1.25, 0.5


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each text, sorted; offsets of each text's)."""
    _, _, _, words, at = words_of(texts, NOT_WHITE)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), size)
    start = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + at[doc]
    length = np.minimum(n, at[doc + 1] - start)
    grams = length.astype(np.uint64)
    for k in range(n):
        on = slice(None) if k == 0 or not len(length) or length.min() > k else np.flatnonzero(length > k)
        grams[on] = chained(grams[on], words[start[on] + k])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = group_runs([doc, grams]) if len(doc) else np.zeros(0, bool)
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


def set_keys(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, as two longs."""
    out = []
    for salt in (0x51, 0xA7):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


@dataclass(frozen=True)
class Level:
    """Sizes low..high; sets of these sizes whose smaller one is below the next level's low meet here."""

    number: int
    low: int
    high: int
    buckets: int
    spare: int


def levels(threshold: int, largest: int) -> list[Level]:
    """Levels for sizes up to ``largest``; those where only equal sets are similar are left out."""
    out, low, k = [], 1, 0
    while low <= largest:
        after = max(low + 1, int(low * RATIO))
        high = (after - 1) * 100 // threshold
        differ = (after - 1 + high) * (100 - threshold) // (100 + threshold)
        if differ:
            spare = 2 + int(SPARE * differ)
            out.append(Level(k, low, high, differ + 1 + spare, spare))
        low, k = after, k + 1
    return out


def bucket_keys(grams: np.ndarray, off: np.ndarray, threshold: int, deal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set of each): two sets that may be similar have a key in common, in every deal of n-grams into buckets."""
    size = np.diff(off)
    keys, sets = [], []
    turn = mix(np.array([deal], np.uint64)) if deal else np.zeros(1, np.uint64)
    for level in levels(threshold, int(size.max(initial=0))):
        own = np.flatnonzero((size >= level.low) & (size <= level.high))
        if not len(own):
            continue
        count = size[own]
        place = np.repeat(np.arange(len(own)), count)
        g = grams[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[own], count)]
        h = mix(g ^ turn ^ np.uint64(0x9E3779B97F4A7C15 * (level.number + 1) % (1 << 64)))
        bucket = ((h >> np.uint64(32)) * np.uint64(level.buckets) >> np.uint64(32)).astype(np.int64) + place * level.buckets
        v = mix(g + np.uint64(0x1234567))
        bins = len(own) * level.buckets
        low, high = (np.bincount(bucket, weights=x.astype(np.float64), minlength=bins).astype(np.uint64) for x in (v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)))
        size_of = np.bincount(bucket, minlength=bins)
        salt = np.tile(np.arange(level.buckets, dtype=np.uint64) + np.uint64(level.number << 32), len(own))
        key = mix(mix(low + np.uint64(0xABCD)) + high * np.uint64(0xD6E8FEB86659FD93) + mix(salt))
        # The buckets with the fewest n-grams, ``spare`` of them, are left out: of the more than ``spare`` buckets on
        # which similar sets agree, the fullest stands above as many others in both sets, so both keep it.
        rank = np.lexsort((key, size_of, np.repeat(np.arange(len(own)), level.buckets))).reshape(len(own), level.buckets)
        at = rank[:, level.spare :].ravel()
        keys.append(key[at])
        sets.append(own[at // level.buckets])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def key_counts(size: np.ndarray, threshold: int) -> np.ndarray:
    """How many keys ``bucket_keys`` gives sets of these sizes."""
    out = np.zeros(len(size), np.int64)
    for level in levels(threshold, int(size.max(initial=0))):
        out[(size >= level.low) & (size <= level.high)] += level.buckets - level.spare
    return out


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by key and node -> (first row of each key, rows that are another node than their key's first, that first row)."""
    new = group_runs([key])
    first = np.flatnonzero(new)
    head = np.repeat(first, np.diff(np.append(first, len(key))))
    other = np.flatnonzero(node != node[head])
    return first, other, head[other]


def _forest(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Edges between nodes -> the same components as one edge from their smallest node to each other node."""
    node, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = number[: len(a)], number[len(a) :]
    label = np.arange(len(node))
    while len(u) and (label[u] != label[v]).any():
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        label = label[label]
    other = np.flatnonzero(label != np.arange(len(label)))
    root = label[other]
    while (label[root] != root).any():
        root = label[root]
    return [node[root], node[other]]


#: Keys that meet in one task of ``_meet``; their parts grow in number with the input, not in size.
PART_KEYS = 500_000
_KEYED = pa.schema([("part", pa.int32()), ("met", pa.bool_()), ("x", pa.binary()), ("y", pa.binary())])
_KEYED_SQL = "part int, met boolean, x binary, y binary"
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _packed(met: bool, by: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int) -> pa.RecordBatch:
    """x and y, sorted by the hash ``by``, as one row for each part that has any."""
    part = ((by.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(group_runs([part]))
    ends = pa.py_buffer((np.append(first, len(part)) * 8).astype(np.int32))
    packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(np.ascontiguousarray(z))]) for z in (x, y)]
    return pa.record_batch([pa.array(part[first]), pa.array(np.full(len(first), met)), *packed], schema=_KEYED)


def _keyed(n: int, threshold: int, parts: int, deal: int = 0):
    """Texts -> keys and their nodes to meet others', and edges (met) between nodes that met already in this piece.

    In a further deal, rows (text, k1, k2, comp): only nodes of one group meet.

    Both are packed, a row for each part of the hash range: the keys are many
    and hardly any is met twice, so that rows of their own, sorted by Spark,
    would cost the executors several times the keys' bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                grams, off = ngram_sets(piece.column(0), n)
                key, own = bucket_keys(grams, off, threshold, deal)
                k1, k2 = set_keys(grams, off)
                if deal:
                    e1, e2, comp = (piece.column(c).to_numpy() for c in ("k1", "k2", "comp"))
                    mine = ((k1 == e1) & (k2 == e2))[own]  # else another row with the same id
                    key, own = mix(key[mine] ^ mix(comp.astype(np.int64).view(np.uint64)[own[mine]])), own[mine]
                if not len(key):
                    continue
                node = k1[own]
                order = np.lexsort((node, key))
                key, node = key[order].view(np.int64), node[order]
                first, other, head = _stars(key, node)
                yield _packed(False, key[first], key[first], node[first], parts)
                a, b = _forest(node[head], node[other])
                order = np.argsort(b.view(np.uint64))
                yield _packed(True, b[order], a[order], b[order], parts)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed rows of one part -> the components of the nodes that share a key, in few edges."""
    held = {False: ([], []), True: ([], [])}
    for batch in batches:
        met = batch.column("met")
        for kind, mask in ((True, met), (False, pc.invert(met))):
            for out, name in zip(held[kind], "xy"):
                out.append(flat_bytes(batch.column(name).filter(mask))[0].copy().view(np.int64))
    if not held[True][0]:
        return
    (key, node), (a, b) = (map(np.concatenate, held.pop(kind)) for kind in (False, True))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    _, other, head = _stars(key, node)
    yield pa.record_batch(list(map(pa.array, _forest(np.concatenate([a, node[head]]), np.concatenate([b, node[other]])))), schema=_EDGE)


class SignatureTree:
    """Sets sorted by size under a tree of OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.sets, self.threshold = sets, threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        n = len(sets)
        self.bits = np.zeros((n, BITS // 64), np.uint64)
        doc = np.repeat(np.arange(n), self.size)
        bit = (np.concatenate(sets) >> np.uint64(53)).astype(np.int64) if n else np.zeros(0, np.int64)
        np.bitwise_or.at(self.bits, (doc, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        self.count = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.parent = np.arange(n)
        #: Nodes: documents lo..hi, children (a range of nodes of the level below), bitmap, sizes, fewest bits.
        self.lo, self.hi, self.child = [], [], []
        for lo in range(0, n, LEAF):
            self._add(lo, min(n, lo + LEAF), None)
        begin, end = 0, len(self.lo)
        while end - begin > 1:
            for c in range(begin, end, FAN):
                last = min(end, c + FAN)
                self._add(self.lo[c], self.hi[last - 1], (c, last))
            begin, end = end, len(self.lo)
        self.one = [False] * len(self.lo)
        self.either = [np.bitwise_or.reduce(self.bits[a:b], axis=0) for a, b in zip(self.lo, self.hi)]
        self.fewest = [int(self.count[a:b].min()) for a, b in zip(self.lo, self.hi)]
        self.least, self.most = [int(self.size[a]) for a in self.lo], [int(self.size[b - 1]) for b in self.hi]

    def _add(self, lo: int, hi: int, child: tuple[int, int] | None) -> None:
        self.lo.append(lo)
        self.hi.append(hi)
        self.child.append(child)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def whole(self, node: int) -> bool:
        """Whether all documents below are linked with each other; stays true."""
        if not self.one[node]:
            if (child := self.child[node]) is not None:
                self.one[node] = all(self.whole(c) for c in range(*child)) and len({self.find(self.lo[c]) for c in range(*child)}) == 1
            else:
                self.one[node] = len({self.find(x) for x in range(self.lo[node], self.hi[node])}) == 1
        return self.one[node]

    def may_link(self, a: int, b: int) -> bool:
        """Whether a document below a and one below b can reach the threshold; a holds no larger sizes than b."""
        t = self.threshold
        if self.most[a] * 100 < t * self.least[b]:
            return False
        shared = int(np.bitwise_count(self.either[a] & self.either[b]).sum())
        # x of a has fewest[a] - shared bits at least that no y of b has, each by an n-gram of its own; likewise y.
        x, y = self.most[a], self.most[b]
        overlap = min(x - max(0, self.fewest[a] - shared), y - max(0, self.fewest[b] - shared))
        return overlap * (100 + t) >= t * (self.least[a] + self.least[b])

    def join(self, labels: np.ndarray) -> None:
        """Links documents with equal labels."""
        first: dict[int, int] = {}
        self.parent = np.array([first.setdefault(x, i) for i, x in enumerate(labels.tolist())], np.int64)

    def compare(self, a: int, b: int, cross: np.ndarray | None) -> None:
        """Two leaves: bounds from the documents' own bitmaps, then exact intersections."""
        i, j = np.arange(self.lo[a], self.hi[a]), np.arange(self.lo[b], self.hi[b])
        common = np.bitwise_count(self.bits[i][:, None] & self.bits[j][None]).sum(axis=2, dtype=np.int64)
        overlap = np.minimum(self.size[i][:, None] - self.count[i][:, None] + common, self.size[j][None] - self.count[j][None] + common)
        ok = overlap * (100 + self.threshold) >= self.threshold * (self.size[i][:, None] + self.size[j][None])
        if a == b:
            ok &= i[:, None] < j[None]
        if cross is not None:
            ok &= cross[i][:, None] != cross[j][None]
        for x, y in zip(*np.nonzero(ok)):
            p, q = int(i[x]), int(j[y])
            fp, fq = self.find(p), self.find(q)
            if fp != fq:
                both = len(np.intersect1d(self.sets[p], self.sets[q], assume_unique=True))
                if both * (100 + self.threshold) >= self.threshold * (len(self.sets[p]) + len(self.sets[q])):
                    self.parent[max(fp, fq)] = min(fp, fq)

    def link(self, cross: np.ndarray | None = None) -> np.ndarray:
        """The first member of each document's class. cross: only documents with different values are compared."""
        if self.lo:
            root = len(self.lo) - 1
            stack = [(root, root)]
            while stack:
                a, b = stack.pop()
                if self.whole(a) and (a == b or self.whole(b) and self.find(self.lo[a]) == self.find(self.lo[b])):
                    continue
                if a != b and not self.may_link(a, b):
                    continue
                ca, cb = self.child[a], self.child[b]
                if ca is None and cb is None:
                    self.compare(a, b, cross)
                elif a == b:
                    kids = range(*ca)
                    stack += [(x, y) for x in kids for y in kids if x < y]
                    stack += [(x, x) for x in kids]  # on top: the inside of each first
                else:
                    stack += [(x, y) for x in (range(*ca) if ca else [a]) for y in (range(*cb) if cb else [b])]
        return np.array([self.find(x) for x in range(len(self.sets))], np.int64)


_TASK = ["rep", "k1", "k2", "comp", "i", "j", "side", "label"]


def _linked(n: int, threshold: int):
    """Rows sorted by (comp, i, j) -> (a, b): labels that a link joins. Where a task has two sides, only documents of different sides are compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: list[tuple[int, int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda k: (len(sets[k]), rows[k]))
        _, side, label = (np.array(x) for x in zip(*(rows[k] for k in order)))
        tree = SignatureTree([sets[k] for k in order], threshold)
        tree.join(label)
        root = tree.link(side if side.min() != side.max() else None)
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, root, label)
        a, first = np.unique(label, return_index=True)
        b = least[root[first]]
        return pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, sets, seen = None, [], [], set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, off = ngram_sets(piece.column("text"), n)
                k1, k2 = set_keys(grams, off)
                cols = [piece.column(c).to_pylist() for c in _TASK]
                for row, (rep, e1, e2, comp, i, j, side, label) in enumerate(zip(*cols)):
                    if (k1[row], k2[row]) != (e1, e2):
                        continue  # another row with the same id
                    if group != (comp, i, j):
                        if held:
                            yield solve(held, sets)
                        group, held, sets, seen = (comp, i, j), [], [], set()
                    if (rep, side) not in seen:
                        seen.add((rep, side))
                        held.append((rep, side, label))
                        sets.append(grams[off[row] : off[row + 1]].copy())
        if held:
            yield solve(held, sets)

    return run


def _in_blocks(nodes: DataFrame, block_ngrams: int, count: str, block: str) -> DataFrame:
    """nodes(rep, comp, size) with the number of blocks of their group and the block of each."""
    sizes = nodes.groupBy("comp").agg(F.sum("size").alias("total"))
    blocks = F.when(F.col("total") <= block_ngrams, 1).otherwise(F.ceil(2 * F.col("total") / block_ngrams)).cast("int")
    return nodes.join(sizes.select("comp", blocks.alias(count)), "comp").withColumn(block, F.pmod(F.xxhash64("rep"), F.col(count)).cast("int"))


def _dealt_again(texts: DataFrame, n: int, threshold: int, block_ngrams: int, deal: int) -> tuple[DataFrame, DataFrame]:
    """Texts of large groups -> their nodes, and texts, by the groups that are left of them in another deal; nodes that meet none are left out."""
    nodes = texts.select("rep", "k1", "k2", "size", "comp").distinct()
    parts = 1 + (nodes.agg(F.sum("size")).first()[0] or 0) // PART_KEYS
    met = texts.select("text", "k1", "k2", "comp").mapInArrow(_keyed(n, threshold, parts, deal), _KEYED_SQL)
    edges = staged(met.repartitionById(parts, F.col("part")).mapInArrow(_meet, "a long, b long").distinct(), "edges")
    a, b = (nodes.select(F.col("k1").alias(s), F.col("rep").alias(f"{s}_rep"), F.col("comp").alias(f"{s}_comp")) for s in "ab")
    pairs = edges.join(a, "a").join(b, "b").where("a_comp = b_comp")
    groups = components(pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")), "candidates")
    dropped(edges)
    member = nodes.drop("comp").join(groups, nodes.rep == groups.id).select("rep", "k1", "k2", "size", F.col("component").alias("comp"))
    member = staged(_in_blocks(member, block_ngrams, "nb", "block"), "members")
    dropped(groups)
    again = texts.select("rep", "k1", "k2", "text").join(member.hint("merge"), ["rep", "k1", "k2"])
    return member, staged(again.select(*texts.columns), "texts")


def _across(merged: DataFrame, block_ngrams: int) -> DataFrame:
    """Tasks that compare what the blocks' own searches have not: for each group the cheaper of two ways.

    Either what is not in the group's largest class, in parts, with every block,
    or every block with every other.
    """
    classes = merged.groupBy("comp", "label").agg(F.sum("size").alias("size"))
    group = classes.groupBy("comp").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.sum("size").alias("total"), F.max("size").alias("most"))
    minor = F.col("total") - F.col("most")
    parts = F.when(minor <= block_ngrams, 1).otherwise(F.ceil(2 * minor / block_ngrams)).cast("int")
    group = group.join(merged.groupBy("comp").agg(F.first("nb").alias("n")), "comp")
    group = group.select("comp", "largest", parts.alias("nm"), (parts * F.col("total") + F.col("n") * minor < (F.col("n") - 1) * F.col("total")).alias("few"))
    rows = merged.join(group, "comp")
    columns = ["rep", "k1", "k2", "comp", "label"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = rows.where("few AND label <> largest").select(*columns, F.pmod(F.xxhash64("rep"), F.col("nm")).cast("int").alias("i"), upto("nb").alias("j"), F.lit(0).alias("side"))
    every = rows.where("few").select(*columns, upto("nm").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    pairs = rows.where("NOT few").select(*columns, "block", upto("nb").alias("other")).where("block <> other")
    pairs = pairs.select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return some.unionByName(every).unionByName(pairs)


def _turns(tasks: DataFrame, most: int) -> list[DataFrame]:
    """The tasks in turns that move about ``most`` n-grams each: a text goes to as many tasks as its group has blocks."""
    turns = 1 + (tasks.agg(F.sum("size")).first()[0] or 0) // most
    turn = F.pmod(F.xxhash64("comp", "i", "j"), F.lit(turns))
    return [tasks.where(turn == t).drop("size") for t in range(turns)]


def _labelled(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes whose label is replaced by its component, where it has one."""
    names = classes.select(F.col("id").alias("label"), "component")
    return nodes.join(names, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


@owner
def cluster(documents: DataFrame, n: int = 5, threshold: int = 80, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_shingles, component_id): classes of documents that reach each other by links.

    Two documents link when 100 * |A and B| >= threshold * |A or B|.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                grams, off = ngram_sets(piece.column(1), n)
                k1, k2 = set_keys(grams, off)
                size = np.diff(off)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size), pa.array(k1), pa.array(k2), pa.array(key_counts(size, threshold))], names=["doc_id", "n_shingles", "k1", "k2", "keys"])

    docs = staged(rows.mapInArrow(measure, "doc_id long, n_shingles long, k1 long, k2 long, keys long"), "sets")
    nodes = docs.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"))
    nodes = staged(nodes.where("rep is not null"), "nodes")

    keys = docs.where("doc_id IS NOT NULL").agg(F.sum("keys").alias("n")).first()["n"] or 0
    parts = 1 + keys // PART_KEYS
    met = rows.where("doc_id IS NOT NULL").select("text").mapInArrow(_keyed(n, threshold, parts), _KEYED_SQL)
    edges = staged(met.repartitionById(parts, F.col("part")).mapInArrow(_meet, "a long, b long").distinct(), "edges")
    # Nodes go by the first half of their hash: should two have it in common, both are candidates.
    a, b = (nodes.select(F.col("k1").alias(s), F.col("rep").alias(f"{s}_rep")) for s in "ab")
    groups = components(edges.join(a, "a").join(b, "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")), "candidates")

    dropped(edges)
    member = nodes.join(groups, nodes.rep == groups.id).select("rep", "k1", "k2", "size", F.col("component").alias("comp"))
    member = staged(_in_blocks(member, block_ngrams, "nb", "block"), "members")
    dropped(groups)

    # The candidates grow with the corpus: their table is never broadcast. All texts move once, those of large groups again.
    texts = rows.join(member.hint("merge"), rows.doc_id == member.rep).drop("doc_id")
    texts = staged(texts, "texts")

    ngrams = lambda nodes: nodes.where("nb > 1").agg(F.sum("size")).first()[0] or 0
    tables, left = [member, texts], ngrams(member)
    members, texteds = [member], [texts]  # the last ones' large groups are dealt again
    for deal in range(1, DEALS + 1):
        if not left:
            break
        before = left
        member, texts = _dealt_again(texteds[-1].where("nb > 1"), n, threshold, block_ngrams, deal)
        tables += [member, texts]
        members[-1], texteds[-1] = members[-1].where("nb = 1"), texteds[-1].where("nb = 1")
        members.append(member)
        texteds.append(texts)
        left = ngrams(member)
        if left > DEAL_SHARE * before:
            break
    member, texts = (functools.reduce(DataFrame.unionByName, x) for x in (members, texteds))

    def solved(dealt: DataFrame) -> DataFrame:
        return staged(dealt.select(*_TASK, "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep").mapInArrow(_linked(n, threshold), "a long, b long"), "links")

    def texted(tasks: DataFrame) -> DataFrame:
        large = texts.where("nb > 1").select("rep", "k1", "k2", "text")
        return tasks.hint("merge").join(large, ["rep", "k1", "k2"])

    alone = [F.lit(0).alias("j"), F.lit(0).alias("side")]
    found = solved(texts.select("*", F.col("block").alias("i"), *alone, F.col("rep").alias("label")))
    classes = components(found, "classes")
    if not member.where("nb > 1").isEmpty():
        cut = staged(_labelled(member.where("nb > 1").withColumn("label", F.col("rep")), classes), "members")
        first = F.sum(F.when(F.col("rep") == F.col("label"), F.col("size")).otherwise(0))
        families = cut.groupBy("comp").agg(F.sum("size").alias("total"), first.alias("first")).where("2 * first <= total").select("comp")
        heads = _in_blocks(cut.where("rep = label").drop("nb", "block").join(families, "comp", "left_semi"), block_ngrams, "nb", "block")
        more = solved(texted(heads.select("*", F.col("block").alias("i"), *alone)))
        merged = staged(_labelled(cut, components(more, "classes")), "members")
        tasks = staged(_across(merged, block_ngrams).join(merged.select("rep", "k1", "k2", "size"), ["rep", "k1", "k2"]), "tasks")
        whole = docs.agg(F.sum("n_shingles")).first()[0]
        last = [solved(texted(t)) for t in _turns(tasks, max(whole, block_ngrams))]
        before = classes
        classes = components(functools.reduce(DataFrame.unionByName, last, found.unionByName(more)), "classes")
        dropped(before, cut, more, merged, tasks, *last)
    dropped(found, *tables)

    named = nodes.join(classes, nodes.rep == classes.id, "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    found = docs.join(named, ["k1", "k2"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


@owner
def keep_one(documents: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """The documents without those that are near duplicates of a kept one: of each class, the smallest id stays."""
    gone = cluster(documents, n, threshold).where("component_id != doc_id").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
