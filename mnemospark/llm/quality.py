"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a vector of surface features. Preference pairs (a text of
label 1 over one of label 0) train a linear score by the logistic loss on
feature differences: P(a over b) = sigmoid(w . (x_a - x_b)). A monotone logistic
map, fitted on the same labelled rows, turns the score into a probability of
label 1; ``select_quantile`` keeps what lies above a quantile of the scores.

The model is fitted on at most ``max_rows`` labelled rows (the smallest by a
hash of their id) and ``max_pairs`` pairs, both documented bounds.

Edge cases: null and empty texts have the all-zero feature vector and get a
score like any other; labels that are null or have no document aren't learnt
from; a document with several labels counts once for each; of several documents
with one id, the text that comes last in binary order is learnt from; with one class only
(or no label) every score is that class's share (0.5 without labels); repeated
rows score alike; clashing columns (``score``, ``predicted``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import bounded, flat_bytes, pieces, staged, with_fields, words_of

MAX_TRAINING_ROWS, MAX_PAIRS = 20_000, 60_000

#: Character classes whose share of the text is a feature.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t", "newline": "\n\r", "stop": ".", "comma": ",", "exclamation": "!", "question": "?",
    "bar": "|", "star": "*", "hash": "#", "percent": "%", "dollar": "$", "ampersand": "&", "at": "@", "slash": "/\\", "dash": "-_", "colon": ":;", "quote": "\"'`", "bracket": "()[]{}", "angle": "<>", "sign": "=+~^",
}
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_WHITE = ~WHITE
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[[10, 13]] = False
N_FEATURES = 2 * len(CLASSES) + 13


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and how often its commonest one occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """Rows x N_FEATURES; each text is measured whole."""
    n = len(texts)
    raw, off = flat_bytes(texts)
    size = np.diff(off)
    hist = np.zeros((n, 256))
    step = 1 << 22
    for lo in range(0, len(raw), step):
        part = raw[lo : lo + step]
        doc = np.searchsorted(off, np.arange(lo, lo + len(part)), side="right") - 1
        a, b = doc[0], doc[-1] + 1
        hist[a:b] += np.bincount((doc - a) * 256 + part, minlength=(b - a) * 256).reshape(b - a, 256)
    chars = np.maximum(1, size - hist[:, 128:192].sum(axis=1))
    p = np.stack([hist[:, [ord(c) for c in cs]].sum(axis=1) for cs in CLASSES.values()], axis=1) / chars[:, None]
    share = hist / np.maximum(1, size)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    _, starts, ends, words, at = words_of(texts, NOT_WHITE)
    count = np.diff(at)
    doc = np.repeat(np.arange(n), count)
    some = np.maximum(1, count)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length**2, n) / some - mean**2))
    distinct, most = _distinct(doc, words, n)
    twice = (doc[1:] == doc[:-1]) & (words[1:] == words[:-1])
    same = np.bincount(doc[1:][twice], minlength=n) / some
    pair = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[1:][pair], (words[1:] * np.uint64(3) ^ words[:-1])[pair], n)
    _, ls, _, lines, lat = words_of(texts, NOT_NEWLINE)
    n_lines = np.diff(lat)
    d_lines, _ = _distinct(np.repeat(np.arange(n), n_lines), lines, n)
    other = np.stack(
        [entropy, mean, spread, np.log1p(mean), distinct / some, most / some, same, pairs / np.maximum(1, count - 1), d_lines / np.maximum(1, n_lines), np.log1p(count), np.log1p(count) * distinct / some, np.log1p(n_lines), hist[:, 128:].sum(axis=1) / chars],
        axis=1,
    )
    out = np.concatenate([p, np.log1p(200 * p), other], axis=1)
    out[size == 0] = 0
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Newton's method for the ridge-penalised logistic loss; the last column of x is not penalised if it is constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 7) -> Model:
    """Bradley-Terry weights from pairs of rows with label 1 and 0, then the map to probabilities."""
    k = x.shape[1] if len(x) else N_FEATURES
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = 0.5 if not len(y) else (len(good) + 0.5) / (len(y) + 1)
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    m = min(max_pairs, len(good) * len(bad))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = _fit_logistic(d, np.ones(m), np.ones(m), ridge=0.002 * m)
    s = z @ w
    slope, intercept = _fit_logistic(np.stack([s, np.ones(len(s))], axis=1), y.astype(float), np.ones(len(s)), ridge=1e-3)
    return Model(mean, scale, w, float(slope), float(intercept))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    s = ((x - model.mean) / model.scale * model.weights).sum(axis=1)  # row by row: a score doesn't depend on its batch
    return 1 / (1 + np.exp(-np.clip(model.slope * s + model.intercept, -35, 35)))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_pairs: int = MAX_PAIRS) -> Model:
    """Fits on documents(doc_id, text) and labels(doc_id, quality in 0/1)."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = staged(bounded(marked, "doc_id", max_rows, 11), "labels")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = texts.groupBy("doc_id").agg(F.max("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # as many as there are labels

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = features(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    got = rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(measure, "quality int, x binary").toPandas()
    x = np.stack([np.frombuffer(b) for b in got.x]) if len(got) else np.zeros((0, N_FEATURES))
    order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, int)  # the rows come in any order; the model must not depend on it
    return fit(x[order], got.quality.to_numpy()[order], max_pairs)


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to every row; keep_text as in language_id."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop("score", "predicted")
    at = kept.columns.index(text)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                p = probability(shared.value, features(piece.column(at)))
                own = [i for i in range(piece.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in own] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[piece.schema.names[i] for i in own] + ["score", "predicted"])

    return kept.mapInArrow(rate, with_fields((kept if keep_text else kept.drop(text)).schema, score="double", predicted="integer"))


def select_quantile(scored: DataFrame, drop_share: float = 0.2, accuracy: int = 10_000) -> DataFrame:
    """Keeps the rows whose score reaches the ``drop_share`` quantile of all scores (ties stay)."""
    cut = scored.agg(F.percentile_approx("score", F.lit(float(drop_share)), F.lit(accuracy)).alias("cut")).first()["cut"]
    return scored if cut is None else scored.where(F.col("score") >= F.lit(cut))
