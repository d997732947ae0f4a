"""Token-ID output as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id; every task encodes its
texts and writes one Arrow IPC file whose record batches have two columns:
``ids`` (fixed-size list of unsigned integers) and ``mask`` (fixed-size list of
booleans, false on the padding of the last sequence). All batches of a file have
the same number of rows but the last, so sequence i is row i % rows of batch
i // rows: random access without copying, as the files are memory-mapped. A
second file lists the documents (doc_id, start in the file's ids, n_tokens).

Ids take 16 bits where the vocabulary allows it, else 32. Files are written
under a name of the attempt and listed in a manifest only by tasks that end
well, so lost executors and repeated attempts do no harm.

Edge cases: a null or empty text is its end id alone; null doc_ids come first;
rows with equal doc_id are ordered by text; an empty table gives no file; a
document may span any number of sequences; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import new_path, owner, pieces, staged
from mnemospark.llm._words import WordEncoder, check_words, load_tokenizer

LENGTH, BATCH_SEQUENCES = 2048, 256
MANIFEST = "shard int, path string, docs_path string, n_docs long, n_tokens long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(load_tokenizer(path))
    return _encoders[path]


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-mapped where the file is local."""
    if path.startswith("file:"):
        return pa.ipc.open_file(pa.memory_map(filesystem(path)[1]))
    store, name = filesystem(path)
    return pa.ipc.open_file(store.open_input_file(name))


class SequenceWriter:
    """Cuts a stream of ids into sequences of equal length and writes them."""

    def __init__(self, sink, dtype, length: int = LENGTH, rows: int = BATCH_SEQUENCES):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.dtype, copy=False))
        self.held += len(ids)
        if self.held >= self.rows * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        step = self.rows * self.length
        at = 0
        while len(flat) - at >= step or last and at < len(flat):
            part = flat[at : at + step]
            n = len(part)
            pad = -n % self.length
            mask = np.ones(n + pad, bool)
            mask[n:] = False
            values = np.concatenate([part, np.zeros(pad, self.dtype)]) if pad else part
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            at += n
        self.parts, self.held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        self.out.close()


@owner
def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 1, out: str | None = None, length: int = LENGTH) -> DataFrame:
    """documents(doc_id, text) -> files under ``out`` (the shared folder if None) and their manifest, a row a file."""
    spark = documents.sparkSession
    check_words(load_tokenizer(tokenizer_path))
    out = out or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer = sink = None
        ids, starts, sizes, total = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                encoder = _encoder(tokenizer_path)
                if writer is None:
                    store, folder = filesystem(out)
                    store.create_dir(folder, recursive=True)
                    base = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{folder}/{base}.arrow")
                    writer = SequenceWriter(sink, np.uint16 if max(end_id, encoder.tokenizer.get_vocab_size() - 1) < 1 << 16 else np.uint32, length)
                got, off = encoder.encode(piece.column("text"))
                flat = np.insert(got, off[1:], end_id)
                size = np.diff(off) + 1
                writer.add(flat)
                ids.append(piece.column("doc_id"))
                starts.append(total + np.cumsum(size) - size)
                sizes.append(size)
                total += len(flat)
        if writer is None:
            return
        writer.close()
        sink.close()
        with store.open_output_stream(f"{folder}/{base}.docs.arrow") as docs, pa.ipc.new_file(docs, _DOCS) as index:
            for a, b, c in zip(ids, starts, sizes):
                index.write_batch(pa.record_batch([a.cast(pa.int64()), pa.array(b), pa.array(c.astype(np.int64))], schema=_DOCS))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/{base}.arrow"], "docs_path": [f"{out}/{base}.docs.arrow"], "n_docs": [sum(map(len, starts))], "n_tokens": [total]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def documents_of(path: str, docs_path: str) -> Iterator[tuple[pa.RecordBatch, list[Iterator[np.ndarray]]]]:
    """Batches of a file's documents, and each document's ids as views of the file's batches."""
    ids, index = open_file(path), open_file(docs_path)
    width = ids.schema.field("ids").type.list_size
    rows = ids.get_batch(0).num_rows if ids.num_record_batches else 0

    def views(start: int, n: int) -> Iterator[np.ndarray]:
        while n:
            k = start // (rows * width)
            flat = ids.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
            got = flat[start - k * rows * width :][:n]
            yield got
            start, n = start + len(got), n - len(got)

    for b in range(index.num_record_batches):
        docs = index.get_batch(b)
        yield docs, [views(s, n) for s, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist())]


def digest_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start over all files, n_tokens, ids_crc32) per document, read from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for docs, ids in documents_of(r["path"], r["docs_path"]):
                    crc = []
                    for parts in ids:
                        c = 0
                        for p in parts:
                            c = zlib.crc32(p.astype("<u4"), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(docs.column("start").to_numpy() + r["base"]), docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "docs_path", "base").repartition(n).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
