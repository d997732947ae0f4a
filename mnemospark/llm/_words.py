"""Encoding of white-space separated words with a public tokenizer, batch by batch.

The tokenizer's pre-tokenizer never joins characters across ASCII white space,
so a text's ids are the ids of its words one after the other. Each distinct
word of a batch is encoded once; ids of whole texts are gathered in numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mnemospark.llm._common import HASH, TAIL, eights, flat_bytes, span_hashes

#: Words that a worker remembers (about 60 bytes each); when full, the memory is emptied and filled anew.
MEMO_WORDS = 1_500_000


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


#: Texts on which a tokenizer must give the ids of the words that ``split_words`` finds.
PROBES = [
    "Hello World, this is a test.", "A.B, c. d,e f.  G , h .", "tabs\tand\nlines\r\nand\x0bmore\x0cspace", " at both ends ", "Don't 3.14, 1,000 (a.b.) \"c,\" d: e;f - g_h", "\u00dcber Stra\u00dfe, \u00c0\u00c9 \u6771\u4eac\u3002 \u0645\u0631\u062d\u0628\u0627",
    "<|endoftext|> <|X|> <s> </s> [PAD] <unk> [INST]", "x\u00a0y z\u2003w", "internationalisation UNPRECEDENTED zzzzqqqq", "",
]


def check_words(tokenizer) -> None:
    """Refuses a tokenizer that doesn't work word by word as ``split_words`` takes it to."""
    for text in PROBES:
        words, codes, _ = split_words(pa.array([text], pa.string()))
        ids = [tokenizer.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]
        if [i for c in codes.tolist() for i in ids[c]] != tokenizer.encode(text, add_special_tokens=False).ids:
            raise ValueError("this tokenizer's ids are not those of lower-cased words between white space, which this encoder needs")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, offsets of each text's words).

    Letters A-Z are lowered and a stop or comma between a letter and white space
    is a word of its own: the tokenizer does the same, and fewer words differ.
    """
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special strings are matched before letters are lowered
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z])([.,])(\s)", r"\1 \2\3"))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    off = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, codes, off - off[0]


class Ragged:
    """Growing rows of ids."""

    def __init__(self) -> None:
        self.starts, self.sizes, self.ids, self.rows, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(8192, np.uint16), 0, 0

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        if len(flat) and flat.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        while self.rows + len(rows) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[self.rows : self.rows + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.rows : self.rows + len(rows)] = sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.rows += len(rows)
        self.used += len(flat)

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows, one after the other; size of each)."""
        size = self.sizes[row].astype(np.int64)
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.starts[row] - before, size)
        return self.ids[at], size


class Bytes:
    """Growing bytes of words."""

    def __init__(self) -> None:
        self.raw, self.used = np.zeros(8192, np.uint8), 0

    def add(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the bytes of these spans lie from now on."""
        before = np.cumsum(size) - size
        total = int(size.sum())
        while self.used + total + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.used : self.used + total] = raw[np.arange(total) + np.repeat(start - before, size)]
        self.used += total
        return self.used - total + before

    def equal(self, start: np.ndarray, size: np.ndarray, raw: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
        """Whether spans of these bytes are those of raw."""
        same = size == other_size
        own, theirs = np.ndarray(len(self.raw) - 7, np.dtype("<u8"), self.raw, 0, (1,)), eights(raw)
        who, k = np.flatnonzero(same & (size > 0)), 0
        while len(who):
            tail = TAIL[np.minimum(size[who] - k, 8)]
            differ = (own[start[who] + k] ^ theirs[other[who] + k]) & tail != 0
            same[who[differ]] = False
            k += 8
            who = who[~differ & (size[who] > k)]
        return same


class WordEncoder:
    """ids of whole texts; ``known`` may look words up first (see ``bpe``), the rest is merged by the tokenizer."""

    def __init__(self, tokenizer, known=None):
        self.tokenizer, self.known = tokenizer, known
        self._reset()

    def _reset(self) -> None:
        self.table = Ragged()
        #: The memory: sorted hashes of words, their rows, and their bytes (places and sizes in ``bytes``), to compare on a hit.
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int32), Bytes()
        if self.known is not None:
            self.known.fill(self.table)

    def rows_of(self, words: pa.Array) -> np.ndarray:
        if len(self.keys) > MEMO_WORDS:
            self._reset()
        row = self.known.find(words) if self.known is not None else np.full(len(words), -1, np.int64)
        rest = np.flatnonzero(row < 0)
        if not len(rest):
            return row
        raw, off = flat_bytes(words)
        start, size = off[rest], off[rest + 1] - off[rest]
        key = span_hashes(raw, start, start + size, HASH)[0]
        at = np.searchsorted(self.keys, key)
        taken = np.zeros(len(rest), bool)  # the hash is in the memory
        inside = at < len(self.keys)
        taken[inside] = self.keys[at[inside]] == key[inside]
        hit = np.flatnonzero(taken)
        hit = hit[self.bytes.equal(self.starts[at[hit]], self.sizes[at[hit]], raw, start[hit], size[hit])]
        row[rest[hit]] = self.rows[at[hit]]
        fresh = np.flatnonzero(row[rest] < 0)
        if len(fresh):
            first = self.table.rows
            self.table.extend([e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest[fresh])).to_pylist(), add_special_tokens=False)])
            row[rest[fresh]] = first + np.arange(len(fresh))
            new = fresh[~taken[fresh]]  # a word whose hash is another's isn't remembered
            order = new[np.argsort(key[new], kind="stable")]
            where = at[order]
            self.keys = np.insert(self.keys, where, key[order])
            self.rows = np.insert(self.rows, where, row[rest[order]].astype(np.int32))
            self.starts = np.insert(self.starts, where, self.bytes.add(raw, start[order], size[order]))
            self.sizes = np.insert(self.sizes, where, size[order].astype(np.int32))
        return row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each)."""
        words, codes, off = split_words(texts)
        row = self.rows_of(words)  # may replace the table
        ids, size = self.table.gather(row[codes])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[off]
