"""Substring search by trigram postings, verified on the texts.

Postings are rows (gram, id): the three-byte pieces of each lower-cased text,
once each, in folders by a hash of the gram and sorted by it. A search reads the
folders of the rarest grams of its patterns, intersects their ids and looks for
the pattern itself in the texts of these ids alone.

Edge cases: a null text or id is found by nothing; a pattern of fewer than three
bytes is looked for in all texts; an empty one is in every text; % and _ are
ordinary characters; letters are compared in lower case; repeated ids are found
when one of their texts has the pattern; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources import storage

#: Folders of postings, and grams of a pattern that a search intersects.
FOLDERS, RAREST = 64, 4
#: Ids up to which a search asks the texts' files for these ids alone.
MAX_IDS = 5_000
#: Bytes of text that one numpy step works on.
PIECE = 4 << 20


def _grams(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.int32)
    return np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) if len(x) > 2 else np.zeros(0, np.int32)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, ids, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g = _grams(t.encode())
            grams.append(g)
            ids.append(np.full(len(g), i, np.int64))
            size += len(t)
            if size > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(ids))], names=["gram", "id"])
                grams, ids, size = [], [], 0
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(ids))], names=["gram", "id"])


class TrigramIndex:
    """An index of texts(id, text), for any number of searches; all rows are indexed."""

    def __init__(self, texts: DataFrame):
        self.texts = texts.select("id", F.lower("text").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
        spark = texts.sparkSession
        found = self.texts.mapInArrow(_postings, "gram int, id long").withColumn("folder", F.pmod(F.hash("gram"), F.lit(FOLDERS)))
        self.path = storage.new_path(spark, "postings")
        # A frequent gram's rows are dealt to several tasks and files.
        dealt = found.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("folder", "gram", "id")
        dealt.write.partitionBy("folder").parquet(self.path)
        self.rows = spark.read.schema("gram int, id long, folder int").parquet(self.path)

    def _read(self, grams: list[int]) -> DataFrame:
        """The postings of some grams; only their folders are opened."""
        spark = self.rows.sparkSession
        folders = [r.f for r in spark.createDataFrame([(g,) for g in grams], "gram int").select(F.pmod(F.hash("gram"), F.lit(FOLDERS)).alias("f")).distinct().collect()]
        return self.rows.where(F.col("folder").isin(folders) & F.col("gram").isin(grams)).select("gram", "id")

    def candidates(self, patterns: list[str]) -> DataFrame:
        """(no, id): texts that have the rarest grams of each pattern (by its number); patterns of under three bytes are left out."""
        spark = self.rows.sparkSession
        of = {i: _grams(p.lower().encode()).tolist() for i, p in enumerate(patterns)}
        every = sorted({g for gs in of.values() for g in gs})
        count = {r.gram: r.n for r in self._read(every).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()} if every else {}  # a row a gram of the patterns
        rare = {i: sorted(gs, key=lambda g: (count.get(g, 0), g))[:RAREST] for i, gs in of.items() if gs and all(g in count for g in gs)}
        wanted = sorted({(i, g, len(gs)) for i, gs in rare.items() for g in gs})
        if not wanted:
            return spark.createDataFrame([], "no int, id long")
        asked = spark.createDataFrame(wanted, "no int, gram int, of int")
        hits = self._read([g for _, g, _ in wanted]).distinct().join(F.broadcast(asked), "gram")  # the patterns' own few grams
        return hits.groupBy("no", "id").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of")).where("n = of").select("no", "id")

    def search(self, patterns: list[str]) -> DataFrame:
        """(pattern, id) of every pattern that a text contains, whatever the case."""
        spark = self.rows.sparkSession
        patterns = list(dict.fromkeys(patterns))
        ask = spark.createDataFrame([(i, p, p.lower()) for i, p in enumerate(patterns)], "no int, pattern string, low string")
        likely = storage.staged(self.candidates(patterns), "candidates")
        ids = [r.id for r in likely.select("id").distinct().limit(MAX_IDS + 1).collect()]
        texts = self.texts.where(F.col("id").isin(ids)) if len(ids) <= MAX_IDS else self.texts
        found = texts.join(likely, "id").join(F.broadcast(ask), "no").where(F.contains("text", F.col("low"))).select("pattern", "id").distinct()
        short = [i for i, p in enumerate(patterns) if len(p.lower().encode()) < 3]
        if short:
            scan = self.texts.crossJoin(F.broadcast(ask.where(F.col("no").isin(short))))  # the short patterns
            found = found.unionByName(scan.where(F.contains("text", F.col("low"))).select("pattern", "id").distinct())
        return found
