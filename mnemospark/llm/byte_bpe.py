"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, offsets, and decoding by the byte table.

The ranks of a vocabulary (token bytes and their ids) are turned into a
tokenizer of the library: each byte is shown as one character (``byte_chars``),
and each token is merged from the two parts that merging by rank makes of it.
No other two parts of a token ever meet: inside a token's bytes, merging goes on
as if they stood alone. A piece that is a token by itself is that token.

A text is cut where white space follows other characters, which no match of the
pattern crosses; each distinct part of a batch is encoded once and remembered.
``Tokenizer`` and token bytes are bounded by the vocabulary and go to the
workers as one broadcast of a few megabytes.

Decoding joins the bytes of the ids (``byte table``). A token may end inside a
character: its offsets then cover the whole character, and decoded text has
U+FFFD only where the ids, taken together, aren't whole characters;
``decode_parts`` carries the bytes of a split character over to the next part.

Edge cases: null and empty texts have no ids and decode to the empty string;
special strings are ordinary text; repeated rows repeat; an empty table gives no
rows; null ids decode to the empty string, unknown ids fail; clashing columns
(``ids``, ``offsets``, ``decoded``) are replaced. A text of any length is cut
into parts, but a run without white space is one part, held by one worker.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import flat_bytes, pieces, with_fields
from mnemospark.llm._words import WordEncoder

#: Texts on which the parts between white space must give the ids of the whole text.
PROBES = ["I'll say: it's 3.14, isn't it?  Two  spaces\n\n\tand tabs \r\n end ", "世界 123abc_été x　y\u0085z", " lead", "x   ", "\x1c \x1f\x00 ...!!! ..... <|endoftext|>", ""]


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b if shown[b] else next(hidden)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank leaves of a token's bytes before the last merge; None if it gets stuck."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks) + 256:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the library that merges by these ranks inside each match of the pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [p for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 and (p := parts_of(t, ranks))]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges], ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


def white_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(raw >= 0xC2)
    at = at[(raw[at] == 0xC2) | ((raw[at] >= 0xE1) & (raw[at] <= 0xE3))]
    if len(at):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b, c = raw[at], padded[at + 1], padded[at + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        out[at[two | three]] = True
        out[at[two | three] + 1] = True
        out[at[three] + 2] = True
    return out


def spaced_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts, cut before white space that follows something else; offsets of each text's parts)."""
    raw, off = flat_bytes(texts)
    space = white_space(raw)
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    begins[off[:-1]] = True
    begins = np.flatnonzero(begins[: len(raw)])
    bounds = np.append(begins, len(raw)).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    return parts, np.searchsorted(begins, off)


class ByteBpe:
    """A worker's encoder and byte table."""

    def __init__(self, tokenizer: str, tokens: Iterable[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokens = list(tokens)
        self.encoder = WordEncoder(Tokenizer.from_str(tokenizer))
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each)."""
        parts, off = spaced_parts(texts)
        coded = parts.dictionary_encode()
        row = self.encoder.rows_of(coded.dictionary)  # may replace the table
        ids, size = self.encoder.table.gather(row[coded.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[off]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, one after the other; where each id's bytes begin, and the end)."""
        if len(ids) and (ids.max() >= len(self.size) or ids.min() < 0):
            raise ValueError("an id outside the vocabulary")
        size = self.size[ids]
        bound = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(bound[-1])) + np.repeat(self.start[ids] - bound[:-1], size)
        return self.raw[at], bound

    def offsets(self, texts: pa.Array, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points [start, end) of its text that each id's bytes lie in."""
        raw, text_off = flat_bytes(texts)
        bound = np.concatenate([[0], np.cumsum(self.size[ids])])
        if bound[-1] != len(raw):
            raise ValueError("the pattern leaves characters out")
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the code point that a byte lies in
        first = np.append(char, char[-1] + 1 if len(char) else 0)[text_off[:-1]]
        before = np.repeat(first, np.diff(off))
        return char[bound[:-1]] - before, char[bound[1:] - 1] + 1 - before


@functools.cache
def _model(tokenizer: str, tokens: tuple[bytes, ...]) -> ByteBpe:
    return ByteBpe(tokenizer, tokens)


class Codec:
    """Encoding and decoding by the ranks of a file and a pattern; sent to the workers as it is, once."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        ranks = load_ranks(ranks_path)
        by_id = {r: t for t, r in ranks.items()}
        if sorted(by_id) != list(range(len(ranks))):
            raise ValueError("ids must be 0, 1, 2 and so on")
        made = tokenizer_json(ranks, pattern), tuple(by_id[i] for i in range(len(ranks)))
        self._check(ByteBpe(*made))
        self.shared = spark.sparkContext.broadcast(made)  # a few megabytes, by the size of the vocabulary

    @staticmethod
    def _check(model: ByteBpe) -> None:
        """Refuses a pattern whose matches cross the cuts of ``spaced_parts`` or leave characters out."""
        for text in PROBES:
            tokenizer, whole = model.encoder.tokenizer, model.encoder.tokenizer.encode(text, add_special_tokens=False).ids
            begins = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
            cuts = {*np.cumsum([0, *map(len, spaced_parts(pa.array([text], pa.string()))[0].to_pylist())]).tolist()} - {len(text)}
            if not cuts <= begins or model.bytes_of(np.array(whole, np.int64))[0].tobytes() != text.encode():
                raise ValueError("the pattern's matches must not join white space to what stands before it, nor leave characters out")

    @property
    def model(self) -> ByteBpe:
        return _model(*self.shared.value)


def _lists(off: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def encode(documents: DataFrame, codec: Codec, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ids, the token ids of the whole text, and, if wanted, offsets: the code points that each token's bytes lie in."""
    kept = documents.drop("ids", *["offsets"] * offsets)
    at = kept.columns.index(text)
    more = {"ids": "array<int>"} | ({"offsets": "array<struct<start:int,end:int>>"} if offsets else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                ids, off = codec.model.encode(piece.column(at))
                out = [_lists(off, pa.array(ids.astype(np.int32)))]
                if offsets:
                    ends = [pa.array(x.astype(np.int32)) for x in codec.model.offsets(piece.column(at), ids, off)]
                    out.append(_lists(off, pa.StructArray.from_arrays(ends, ["start", "end"])))
                yield pa.RecordBatch.from_arrays([*piece.columns, *out], names=[*piece.schema.names, *more])

    return kept.mapInArrow(run, with_fields(kept.schema, **more))


def _list_ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all lists, offsets of each)."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off - off[0]


def decode(encoded: DataFrame, codec: Codec, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids; bytes that aren't whole characters become U+FFFD."""
    kept = encoded.drop("decoded").withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = _list_ids(batch.column(at))
            raw, bound = codec.model.bytes_of(flat)
            view = raw.tobytes()
            ends = bound[off].tolist()
            texts = pa.array([view[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, with_fields(kept.schema, decoded="string"))


def decode_parts(parts: Iterable[Iterable[int]], model: ByteBpe) -> Iterator[str]:
    """Texts of consecutive parts of a document's ids; a character split between parts comes with its last byte."""
    whole = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield whole.decode(model.bytes_of(np.fromiter(part, np.int64))[0].tobytes())
    if rest := whole.decode(b"", True):
        yield rest


def encode_then(documents: DataFrame, codec: Codec, columns: list[str], schema: str, digest: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """columns of documents and what digest(ids, their offsets, decoded bytes, their offsets) gives; texts never leave the worker."""
    kept = documents.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, len(columns)):
                ids, off = codec.model.encode(piece.column(len(columns)))
                raw, bound = codec.model.bytes_of(ids)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(columns)], *digest(ids, off, raw, bound[off])], names=names)

    full = with_fields(documents.select(*columns).schema, **dict(x.split(" ") for x in schema.split(", ")))
    names = full.fieldNames()
    return kept.mapInArrow(run, full)
