"""Exact deduplication by content sort, in DataFrame operations only.

Texts are equal when they are identical after every white-space character is
deleted. Keys of a sample of rows give splitters; every row goes to the range
partition of its key, where sorting by the whole normalised text places equal
texts next to each other and comparing neighbours in full finds the groups. Of
a group, the row with the most characters in the original text stays, then the
smallest id.

The splitter key ends in a hash of the id, so a large group is cut into several
ranges. Only groups that a splitter cuts lie in more than one range (fewer
groups than splitters, whatever the data); their parts are merged afterwards.

Edge cases: null counts as the empty text; null ids sort after all others;
repeated rows (same id and text) are one group, of which one row stays; an
empty table gives no rows; other columns pass through where asked for, except
those named like the result's, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import owner, staged

#: The white-space characters U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Sampled keys for each splitter.
SAMPLES = 40
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _key(norm: Column, digest: Column, doc_id: str) -> Column:
    """Sort key: begin of the text, its digest (equal texts stay together), then a hash of the id."""
    return F.concat(F.substring(norm, 1, 16), F.lit("\0"), digest, F.lit("\0"), F.hex(F.xxhash64(doc_id)))


def _splitters(documents: DataFrame, n: int, doc_id: str, text: str) -> list[str]:
    """At most n - 1 keys, from a sample of about SAMPLES * n rows, of which only these keys come to the driver."""
    total = documents.count()  # of a Parquet table: read from the footers
    sample = documents if total <= SAMPLES * n else documents.sample(SAMPLES * n / total, seed=42)
    norm = normalised(text)
    keys = sample.select(_key(norm, F.sha2(norm, 256), doc_id).alias("k"))
    place = keys.withColumn("i", F.row_number().over(Window.orderBy("k")) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    part = lambda i: F.floor(i * n / F.col("m"))
    return sorted({r.k for r in place.where((F.col("i") > 0) & (part(F.col("i")) > part(F.col("i") - 1))).select("k").collect()}, key=str.encode)


def _listed(strings: list[str]) -> Column:
    """An array of strings without line ends, as one literal of the plan (folded by the optimizer)."""
    return F.split(F.lit("\n".join(strings)), "\n")


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are <= key: a binary search."""
    if not splitters:
        return F.lit(0)
    every = _listed(splitters)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.element_at(every, F.least(middle + 1, F.lit(len(splitters)))) <= key
        lo, hi = F.when(below, middle + 1).otherwise(s["lo"]), F.when(below, s["hi"]).otherwise(middle)
        return F.when(s["lo"] < s["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length())), start, halve)["lo"]


@owner
def mark(documents: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256.

    carry: columns to return beside them (all by default).
    """
    spark = documents.sparkSession
    carry = [c for c in (carry or documents.columns) if c not in RESULT]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(documents.select(doc_id, text), n, doc_id, text)
    rows = documents.select(*dict.fromkeys([*carry, doc_id]), F.length(F.coalesce(text, F.lit(""))).alias("__chars"), normalised(text).alias("__norm"))
    keyed = rows.withColumn("text_sha256", F.sha2("__norm", 256)).withColumn("__key", _key(F.col("__norm"), F.col("text_sha256"), doc_id))
    ranged = keyed.withColumn("__range", _range_of(F.col("__key"), splitters)).drop("__key")
    if text in carry:  # one text is enough to move
        ranged = ranged.drop("__norm").repartitionById(len(splitters) + 1, F.col("__range")).withColumn("__norm", normalised(text))
    else:
        ranged = ranged.repartitionById(len(splitters) + 1, F.col("__range"))
    group = Window.partitionBy("__range", "__norm")
    first = group.orderBy(F.desc("__chars"), F.col(doc_id).asc_nulls_last())
    local = ranged.withColumn("__place", F.row_number().over(first)).withColumn("__keep", F.first(F.struct(F.col("__range").alias("r"), (-F.col("__chars")).alias("c"), F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"))).over(first)).withColumn("__size", F.count(F.lit(1)).over(group))
    local = staged(local.select(*carry, "text_sha256", "__range", "__place", "__keep", "__size"), "exact-dedup")
    cut = spark.range(1).select(F.explode(_listed(sorted({s.split("\0")[-2] for s in splitters}))).alias("text_sha256"))  # no more than splitters
    parts = local.where(F.col("__place") == 1).join(F.broadcast(cut), "text_sha256", "left_semi")
    best = F.min(F.struct(F.col("__keep.c").alias("c"), F.col("__keep.n").alias("n"), F.col("__keep.id").alias("id"), F.col("__keep.r").alias("r")))
    merged = parts.groupBy("text_sha256").agg(best.alias("__best"), F.sum("__size").alias("__total"))
    whole = local.join(F.broadcast(merged), "text_sha256", "left")  # at most one row a splitter
    return whole.select(
        *carry,
        F.coalesce("__best.id", F.when(F.col("__best").isNull(), F.col("__keep.id"))).alias("keep_id"),
        F.coalesce("__total", "__size").alias("group_size"),
        ((F.col("__place") == 1) & (F.col("__best").isNull() | (F.col("__best.r") == F.col("__range")))).alias("kept"),
        "text_sha256",
    )


@owner
def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    return mark(documents, None, doc_id, text).where("kept").select(*[c for c in documents.columns if c not in RESULT])
