"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's most frequent words (counted over all rows) and their token ids are
compiled into a minimal acyclic automaton with shared suffixes. Every edge
carries the number of words that sort before it, so the outputs along a path add
up to the word's rank and the rank addresses its ids: a transducer from words to
ids. It goes to the executors as a broadcast of a few megabytes, so that any that
start later get it, too; a worker writes it to a file and maps that;
distinct words of a batch walk it in lockstep in numpy. Words outside the
lexicon are merged exactly, by the tokenizer's own merge rules. Decoding joins
the vocabulary's strings.

Edge cases: null and empty texts have no ids and decode to the empty string;
white space, invalid or unassigned characters, special strings and texts of any
length give what the tokenizer gives for the whole text; an empty table compiles
an empty lexicon; repeated rows repeat; clashing columns (``ids``, ``decoded``)
are replaced.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm._common import flat_bytes, pieces, staged, with_fields
from mnemospark.llm._words import WordEncoder, check_words, load_tokenizer

#: Words of the lexicon; bounds the automaton (a few MB) whatever the corpus.
LEXICON_WORDS = 65_536
#: Longer words aren't worth a path.
LONGEST_WORD = 48

_PARTS = {"first": np.int32, "label": np.uint8, "target": np.int32, "output": np.int32, "final": np.uint8, "start": np.int64, "ids": np.uint32}


def compile_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words.

    States are numbered by first completion; state s has the edges
    first[s]:first[s+1], sorted by label. Words are added in order and the part
    of the last path that can't change any more is merged with an equal state.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[tuple[bool, list]] = [(False, [])]
    last = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], register[key])

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for c in word[common:]:
            path[-1][1].append((c, -1))
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))
    count = np.zeros(len(states), np.int64)
    first, label, target, output = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # targets are always settled before
        before = int(final)
        for c, t in edges:
            label.append(c)
            target.append(t)
            output.append(before)
            before += count[t]
        count[s] = before
        first.append(len(label))
    return {"first": np.array(first, np.int32), "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "output": np.array(output, np.int32), "final": np.array([f for f, _ in states], np.uint8)}


class Transducer:
    """A memory-mapped automaton; ``find`` gives the ranks of words, ``fill`` the ids by rank."""

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as f:  # the file goes with the mapping
            f.write(raw)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        at = 8 * len(_PARTS)
        for (name, kind), n in zip(_PARTS.items(), whole[:at].view(np.int64).tolist()):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + size].view(kind))
            at += -(-size // 8) * 8
        owner = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.keys = owner * 256 + self.label
        self.root = len(self.first) - 2

    @staticmethod
    def packed(parts: dict[str, np.ndarray]) -> bytes:
        """The parts one after the other, each from a multiple of eight bytes on, after their lengths."""
        out = [np.array([len(parts[k]) for k in _PARTS], np.int64).tobytes()]
        for k, kind in _PARTS.items():
            raw = parts[k].astype(kind).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def fill(self, table) -> None:
        table.extend([self.ids[a:b].tolist() for a, b in zip(self.start[:-1], self.start[1:])])

    def find(self, words: pa.Array) -> np.ndarray:
        """Rank of each word, or -1; all words step through the automaton together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        raw, off = flat_bytes(words)
        size = np.diff(off)
        who = np.flatnonzero((size > 0) & (size <= LONGEST_WORD))
        state = np.full(len(who), self.root, np.int64)
        rank = np.zeros(len(who), np.int64)
        for k in range(LONGEST_WORD + 1):
            ends = size[who] == k
            if ends.any():
                good = ends & (self.final[state] == 1)
                out[who[good]] = rank[good]
                who, state, rank = who[~ends], state[~ends], rank[~ends]
            if not len(who):
                break
            key = state * 256 + raw[off[who] + k]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[e] == key
            who, e = who[on], e[on]
            state, rank = self.target[e].astype(np.int64), rank[on] + self.output[e]
        return out


def frequent_words(documents: DataFrame, n: int = LEXICON_WORDS, text: str = "text") -> list[str]:
    """The most frequent words over all rows, n at most: all words above a count.

    The count is read off a histogram with 16 steps to a doubling, so that only
    the chosen words come to the driver, however many partitions count them.
    """
    spaced = F.regexp_replace(F.lower(text), r"([a-z])([.,])(\s)", "$1 $2$3")
    words = documents.select(F.explode(F.split(spaced, r"[ \t\n\x0B\f\r]+")).alias("w")).where((F.octet_length("w") > 0) & (F.octet_length("w") <= LONGEST_WORD))
    step = F.floor(16 * F.log2("count")).cast("int")
    counts = staged(words.groupBy("w").count().where("count > 1").withColumn("step", step), "words")
    total, least = 0, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 * 63 rows
        total += r["count"]
        if total > n:
            break
        least = r["step"]
    return [] if least is None else [r.w for r in counts.where(F.col("step") >= least).select("w").collect()]


class Lexicon:
    """A compiled lexicon, for all executors there are and will be."""

    def __init__(self, spark: SparkSession, packed: bytes):
        self.name = uuid.uuid4().hex
        self.packed = spark.sparkContext.broadcast(packed)  # bounded by LEXICON_WORDS


def build_lexicon(documents: DataFrame, tokenizer_path: str, n: int = LEXICON_WORDS, text: str = "text") -> Lexicon:
    """Compiles the frequent words of documents and their ids."""
    tokenizer = load_tokenizer(tokenizer_path)
    check_words(tokenizer)
    words = sorted(w.encode() for w in frequent_words(documents, n, text))
    ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
    parts = compile_automaton(words)
    parts["start"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]) if ids else np.zeros(1)
    parts["ids"] = np.array([x for i in ids for x in i])
    return Lexicon(documents.sparkSession, Transducer.packed(parts))


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(tokenizer_path: str, lexicon: Lexicon) -> WordEncoder:
    """The worker's encoder; made once."""
    key = tokenizer_path, lexicon.name
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(load_tokenizer(tokenizer_path), Transducer(lexicon.packed.value))
    return _encoders[key]


_vocabularies: dict[str, pa.Array] = {}


def vocabulary(tokenizer_path: str) -> pa.Array:
    """The token string of each id; only for tokenizers whose decoder just joins tokens with spaces."""
    if tokenizer_path not in _vocabularies:
        tokenizer = load_tokenizer(tokenizer_path)
        if tokenizer.decoder is not None:
            raise ValueError("decode() needs a tokenizer without a decoder of its own")
        _vocabularies[tokenizer_path] = pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], pa.string())
    return _vocabularies[tokenizer_path]


def id_lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))


def joined(strings: pa.Array, lists: pa.Array) -> pa.Array:
    """Strings of each list's ids, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, strings.take(lists.values)), " ")


def encode_batches(batches: Iterator[pa.RecordBatch], at: int, tokenizer_path: str, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, at):
            yield pa.RecordBatch.from_arrays([*piece.columns, id_lists(*encoder(tokenizer_path, lexicon).encode(piece.column(at)))], names=[*piece.schema.names, "ids"])


def encode(documents: DataFrame, tokenizer_path: str, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ids, the token ids of the whole text."""
    kept = documents.drop("ids")
    at = kept.columns.index(text)
    return kept.mapInArrow(lambda b: encode_batches(b, at, tokenizer_path, lexicon), with_fields(kept.schema, ids="array<int>"))


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids (null ids: empty)."""
    kept = encoded.drop("decoded").withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.ListArray.from_arrays(pc.subtract(batch.column(at).offsets, batch.column(at).offsets[0]), batch.column(at).flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns, joined(vocabulary(tokenizer_path), lists)], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, with_fields(kept.schema, decoded="string"))


def encode_then(documents: DataFrame, tokenizer_path: str, lexicon: Lexicon, columns: list[str], schema: str, digest: Callable[[pa.Array, pa.Array], list[pa.Array]]) -> DataFrame:
    """columns of documents and what digest(ids, decoded) gives; ids and decoded texts never leave the worker."""
    kept = documents.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in encode_batches(batches, len(columns), tokenizer_path, lexicon):
            ids = piece.column("ids")
            out = digest(ids, joined(vocabulary(tokenizer_path), ids))
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(columns)], *out], names=names)

    full = with_fields(documents.select(*columns).schema, **dict(x.split(" ") for x in schema.split(", ")))
    names = full.fieldNames()
    return kept.mapInArrow(run, full)
