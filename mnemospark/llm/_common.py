"""Helpers shared by the training-data operators: shared storage, Arrow batches, byte hashing."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.sources.storage import setting, shared_folder

#: Text bytes that one numpy step works on; bounds a worker's memory whatever the batch or text size.
PIECE_BYTES = 2 << 20


#: Rows of an Arrow batch that goes to a Python worker; texts are long, and a batch is held several times at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size for tables of texts, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths made by the operator that runs, for its result to own; a list a thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/mnemospark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(path)
    return path


@contextmanager
def paths_made() -> Iterator[list[str]]:
    """The paths that are made inside; they count as made outside, too."""
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(own)


def owner(f):
    """An operator whose result, a DataFrame, owns what was staged for it (see ``release``).

    If the operator fails, its tables are deleted at once.
    """

    @functools.wraps(f)
    def run(*args, **options):
        with paths_made() as paths:
            try:
                out = f(*args, **options)
            except BaseException:
                if (spark := SparkSession.getActiveSession()) is not None:
                    for path in paths:
                        delete(spark, path)
                raise
        if isinstance(out, DataFrame):
            out._owned = [*paths]
        return out

    return run


def release(result: DataFrame) -> None:
    """Deletes the tables that an operator has staged for its result, and those of nobody else. The result can't be read afterwards."""
    for path in getattr(result, "_owned", ()):
        delete(result.sparkSession, path)
        if path in (own := _made.get() or []):
            own.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, reread.

    The table outlives lost executors; the shuffle files of the job that wrote
    it go as soon as it ends. The result of the operator that called this owns
    the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``staged`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._staged_at)
        if t._staged_at in (own := _made.get() or []):
            own.remove(t._staged_at)


def bounded(rows: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    """At most ``most`` rows: those whose key has the smallest hash.

    A threshold on the hash, from the count, leaves little more than ``most``
    rows to be sorted, however many partitions there are.
    """
    size = 1 << 40
    ranked = rows.withColumn("__hash", F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(size)))
    n = rows.count()
    if n > 2 * most:
        ranked = ranked.where(F.col("__hash") < F.lit(int(size * 1.2 * (most + 1000) / n)))
    return ranked.orderBy("__hash", *rows.columns).limit(most).drop("__hash")


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema and further fields, named with their types as text."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v) if "<" in v else T._parse_datatype_json_value(v)) for k, v in kinds.items())])


def pieces(batch: pa.RecordBatch, column: str | int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a string column; a longer text comes alone."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < n:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    off = offsets(texts)
    return np.diff(off)


def offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets of each (null: empty)."""
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    off = offsets(texts)
    data = texts.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of the chained hashes; each pair is a hash of its own.
HASH, HASH2 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
#: Spans above this many bytes are hashed one by one with BLAKE2; shorter ones together, eight bytes a step.
LONG_SPAN = 256
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chained(h: np.ndarray, x: np.ndarray, kind: tuple[int, int] = HASH) -> np.ndarray:
    """The hash of a sequence that goes on with x: two rounds of xor-multiply-shift, one to one in h and in x.

    Not a polynomial, so no family of structured strings collides; two unequal
    sequences have equal hashes with a probability of about 2**-64.
    """
    h = (h ^ x) * np.uint64(kind[0])
    h ^= h >> np.uint64(32)
    h *= np.uint64(kind[1])
    h ^= h >> np.uint64(29)
    return h


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, 0, (1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *kinds: tuple[int, int]) -> list[np.ndarray]:
    """A hash of each kind of every byte span."""
    view, size = eights(raw), ends - starts
    out = [size.astype(np.uint64) * np.uint64(kind[1]) for kind in kinds]
    who, k = None, 0
    over = size > LONG_SPAN
    if over.any():
        who = np.flatnonzero(~over)
    most = int(size[~over].max(initial=0))
    while k < most:
        if who is None:
            part = view[starts + k] & TAIL[np.minimum(size - k, 8)]
            out = [chained(h, part, kind) for h, kind in zip(out, kinds)]
        elif len(who):
            part = view[starts[who] + k] & TAIL[np.minimum(size[who] - k, 8)]
            for h, kind in zip(out, kinds):
                h[who] = chained(h[who], part, kind)
        k += 8
        who = np.flatnonzero((size > k) & ~over) if who is None else who[size[who] > k]
    flat = memoryview(np.ascontiguousarray(raw))
    for i in np.flatnonzero(over).tolist():
        got = np.frombuffer(hashlib.blake2b(flat[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
        for h, kind in zip(out, kinds):
            h[i] = got[0] if kind == HASH else got[1]
    return out


def window_hashes(raw: np.ndarray, width: int, *kinds: tuple[int, int]) -> list[np.ndarray]:
    """Hashes of all windows of ``width`` bytes, by their starts."""
    n = max(0, len(raw) - width + 1)
    view = eights(raw).copy()
    out = [np.full(n, width, np.uint64) for _ in kinds]
    for k in range(0, width, 8):
        part = view[k : k + n] & TAIL[min(8, width - k)]
        out = [chained(h, part, kind) for h, kind in zip(out, kinds)]
    return out


def word_windows(words: np.ndarray, sizes: Iterable[int], kind: tuple[int, int] = HASH) -> dict[int, np.ndarray]:
    """Hashes of all windows of each size (in words, given by their hashes), by their starts."""
    out, wanted = {}, set(sizes)
    h = np.full(len(words), kind[1], np.uint64)
    for k in range(1, max(wanted, default=0) + 1):
        if len(words) < k:
            break
        h = chained(h[: len(words) - k + 1], words[k - 1 :], kind)
        if k in wanted:
            out[k] = h
    return out


UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def word_spans(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: starts, ends (bytes) and the offsets of each text's words.

    raw, off: as of ``flat_bytes``. is_word: a table of 256 flags.
    """
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = is_word[raw]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    cut = off[:-1][(off[:-1] < len(raw))]
    begin[cut] = inside[cut]
    end = inside[:-1] & ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    end[last] |= inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def words_of(texts: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, word hashes, offsets of each text's words).

    Long input is hashed in pieces cut between words, so that the wide
    intermediate arrays stay small.
    """
    raw, off = flat_bytes(texts)
    raw = UPPER[raw]
    starts, ends, at = word_spans(raw, off, is_word)
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + PIECE_BYTES)))
        lo, hi = starts[k], ends[to - 1]
        hashes[k:to] = span_hashes(raw[lo:hi], starts[k:to] - lo, ends[k:to] - lo, HASH)[0]
        k = to
    return raw, starts, ends, hashes, at


def group_runs(keys: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before in any key (rows in sorted order)."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return new
