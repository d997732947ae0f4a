"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and rereads them for the next.
All stages but the last return the columns of ``documents``; extra columns of any
name pass through them. A stage's result owns the tables staged for it
(``release``); stages and runs share no state, so any number may go on at once.

Edge cases, for all stages: an empty table gives no rows; repeated rows are
judged one by one, but for exact and near copies, of which one stays; texts are
read whole, however long. Null and empty texts have no letter, so language ID
rejects them; the stages after it take them as empty texts of their own: equal
to each other (exact dedup), similar to nothing (near dedup), clean
(decontamination) and without ids (encoding). A row with a null doc_id is
not learnt from, but judged by language ID; among equal texts it comes after all others; near dedup
leaves such rows in, as no id names them. A null lang is not learnt from; ties
between languages go to the first in sorted order, ties between copies to the
smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from mnemospark.llm._common import dropped, flat_bytes, owner, read, release, small_batches, staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: A document is rejected when it has no letter, or when no language reaches this probability.
MIN_LANGUAGE_SCORE = 0.5
#: Near duplicates: word n-grams of NEAR_WORDS, Jaccard similarity of NEAR_PERCENT and more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _apart(docs: DataFrame) -> DataFrame:
    """Columns other than doc_id and text under names that no operator uses."""
    return docs.select(*[F.col(c).alias(c if c in ("doc_id", "text") else f"in_{c}") for c in docs.columns])


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c if c in ("doc_id", "text") else f"in_{c}").alias(c) for c in docs.columns])


@owner
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language; the model learns from the labelled ones."""
    small_batches(spark)
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(_apart(docs), model)
    return _back(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


@owner
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, one stays."""
    return _back(exact_dedup.deduplicate(_apart(docs)), docs)


@owner
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


@owner
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark windows."""
    return _back(decontaminate.remove_documents(_apart(docs), read(spark, sf_dir, "benchmark")), docs)


def _digest(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    raw, off = flat_bytes(decoded)
    view = memoryview(np.ascontiguousarray(raw))
    return [ids, pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())]


@owner
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (token ids of the whole text), n_tokens and decoded_sha256 (hex digest of the decoded ids)."""
    small_batches(spark)
    lexicon = bpe.build_lexicon(docs.select("text"), TOKENIZER)
    return bpe.encode_then(docs, TOKENIZER, lexicon, ["doc_id"], "ids array<int>, n_tokens long, decoded_sha256 string", _digest)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

#: SQL can't express language ID and n-gram classes; tests compare the stages with brute force.
ORACLE_SQL = None


@owner
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has staged goes as soon as its rows are written, its input thereafter; the result owns its own table alone."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        after = staged(out, name)
        release(out)
        if before is not None:
            dropped(before)
        docs = before = after
    return docs
