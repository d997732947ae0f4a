"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of the lower-cased labelled texts per
language; the smoothed log-probability matrix is broadcast and every batch is
scored in numpy: sparse feature indices, one gather and segment sum a language.

The model is fitted on at most ``max_rows`` labelled rows (the smallest by a
hash of their id) and has at most ``max_languages`` languages (those that most
of these rows have, ties by name), documented bounds; each language weighs the same (uniform
prior), so the mix of the corpus doesn't tilt short texts.

Edge cases: a text that is null or has no letter is ``und`` with score 0; ties
go to the first language in sorted order; with no labelled row everything is
``und``; rows without a language or an id aren't learnt from; repeated rows are
each scored; clashing columns (``lang_pred``, ``score``) are replaced; texts of
any length are scored whole: n-grams across the slices in which a long text is
read count like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import bounded, pieces, with_fields

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_TRAINING_ROWS = 20_000
#: Languages of a model; bounds the broadcast matrix (34 MB).
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Characters of one text that are scored at once.
SLICE_CHARS = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: log-probabilities, languages x (BUCKETS + 1); the last column is 0, for no n-gram.
    weights: np.ndarray


def ngram_buckets(slices: list[tuple[str, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram at each character, for each order, and where each slice starts.

    A slice comes with the number of its own characters: at the others, which
    only complete n-grams, and where an n-gram would run over the end, the
    bucket is BUCKETS.
    """
    sizes = np.fromiter((len(t) for t, _ in slices), np.int64, len(slices))
    own = np.fromiter((n for _, n in slices), np.int64, len(slices))
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(t for t, _ in slices).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    borrowed = np.arange(len(codes)) - np.repeat(ends - sizes, sizes) >= np.repeat(own, sizes)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        nxt = np.zeros_like(codes)
        nxt[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h + nxt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        b = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int32)
        b[borrowed] = BUCKETS
        for k in range(1, n):
            b[np.maximum(ends - k, 0)] = BUCKETS
        out.append(b)
    return out, ends - sizes


def _slices(texts: list[str]) -> Iterator[tuple[int, str, int]]:
    """(row, slice, its own characters) of every text, lower-cased and between two spaces; slices overlap by an n-gram less one, so that none is lost or counted twice."""
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for at in range(0, len(t), SLICE_CHARS):
            yield i, t[at : at + SLICE_CHARS + max(ORDERS) - 1], min(SLICE_CHARS, len(t) - at)


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Rows x languages."""
    out = np.zeros((len(texts), len(model.languages)))
    todo: list[tuple[int, str, int]] = []

    def flush() -> None:
        buckets, starts = ngram_buckets([x[1:] for x in todo])
        rows = np.fromiter((x[0] for x in todo), np.int64, len(todo))
        for k, w in enumerate(model.weights):
            total = sum(np.add.reduceat(w[b], starts, dtype=np.float64) for b in buckets)
            np.add.at(out[:, k], rows, total)
        todo.clear()

    size = 0
    for x in _slices(texts):
        todo.append(x)
        size += len(x[1])
        if size >= SLICE_CHARS:
            flush()
            size = 0
    if todo:
        flush()
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in pieces(batch, "text"):
            langs = piece.column("lang").to_pylist()
            todo = list(_slices(piece.column("text").to_pylist()))
            for lang in sorted(set(langs)):
                own = [x[1:] for x in todo if langs[x[0]] == lang]
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for b in ngram_buckets(own)[0]:
                    total += np.bincount(b, minlength=BUCKETS + 1)
    for lang, total in counts.items():
        some = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS, alpha: float = 0.5, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fits on labelled(doc_id, text, lang); at most ``max_rows`` rows, whatever the table's size, and the ``max_languages`` languages that most of them have."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded(rows.select("doc_id"), "doc_id", max_rows, 5).distinct()
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")
    common = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    sample = sample.join(F.broadcast(common.select("lang")), "lang", "left_semi")
    # At most BUCKETS rows a language come to the driver.
    counted = sample.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted.lang))
    weights = np.zeros((len(languages), BUCKETS + 1), np.float32)
    for k, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        c = np.full(BUCKETS, alpha)
        c[own.bucket.to_numpy()] += own.n.to_numpy()
        weights[k, :BUCKETS] = np.log(c / c.sum())
    return Model(languages, weights)


def identify(documents: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score (posterior of the predicted language) to every row.

    keep_text: whether the text comes back too; without it, texts needn't return from the Python workers.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = documents.drop("lang_pred", "score")
    at = kept.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in pieces(batch, at):
                texts = [t if ok else "" for t, ok in zip(piece.column(at).to_pylist(), piece.column(piece.num_columns - 1).to_pylist())]
                known = np.fromiter((t != "" for t in texts), bool, len(texts)) if m.languages else np.zeros(len(texts), bool)
                if m.languages:
                    ll = log_likelihoods(m, texts)
                    best = ll.argmax(axis=1)
                    p = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                names = [m.languages[best[i]] if known[i] else UNKNOWN for i in range(len(texts))]
                scores = np.where(known, p, 0.0) if m.languages else np.zeros(len(texts))
                own = [i for i in range(piece.num_columns - 1) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in own] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[piece.schema.names[i] for i in own] + ["lang_pred", "score"])

    schema = with_fields((kept if keep_text else kept.drop(text)).schema, lang_pred="string", score="double")
    return kept.withColumn("__has_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold that isn't learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold
