"""Sorting, top-k and deduplication; every order ends in a unique key.

Edge cases, for all of them: null scores come last (``top_n``: count as 0); ties
go to the smaller id; repeated rows count each; fewer rows than asked for are
all returned; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, by: str | Column, ident: str = "id", ascending: bool = False) -> DataFrame:
    """The n rows with the largest (smallest) value; a missing value counts as 0."""
    key = F.coalesce(F.col(by) if isinstance(by, str) else by, F.lit(0.0))
    return df.orderBy(key.asc() if ascending else key.desc(), ident).limit(n)


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def best_per(df: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    """(key, best row's ident, its score): a pre-aggregated maximum instead of a window."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(ident)).alias("i"))).alias("m")
    return df.groupBy(key).agg(best).select(key, (-F.col("m.i")).alias(ident), F.col("m.s").alias(score))


def combine(frames: list[DataFrame], key: str) -> DataFrame:
    """Bag union, then the row of the earliest frame for each key."""
    every = None
    for i, f in enumerate(frames):
        f = f.withColumn("__from", F.lit(i))
        every = f if every is None else every.unionByName(f)
    return first_per(every, [key], ["__from"]).drop("__from")


def ranked(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows per key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def two_stage(df: DataFrame, first: str | Column, candidates: int, score: Column, n: int, ident: str = "id") -> DataFrame:
    """(ident, score): of the ``candidates`` rows with the largest first value, the n that score best."""
    few = df.orderBy((F.col(first) if isinstance(first, str) else first).desc_nulls_last(), ident).limit(candidates)
    return few.select(ident, score.alias("score")).orderBy(F.desc_nulls_last("score"), ident).limit(n)


def over_levels(levels: dict[str, DataFrame], n: int, ident: str = "id") -> DataFrame:
    """(ident, level, idx, score): the n best over tables (ident, idx, score) of several levels."""
    every = None
    for name, df in levels.items():
        df = df.select(ident, F.lit(name).alias("level"), F.col("idx").cast("long").alias("idx"), "score")
        every = df if every is None else every.unionByName(df)
    return every.orderBy(F.desc_nulls_last("score"), ident, "level", "idx").limit(n)


def learnings(df: DataFrame, group: str, context: str, time: str, succeeded: Column, n: int, ident: str) -> DataFrame:
    """Of each group's 2 n newest rows n, failures first; a success counts once a context, a failure each."""
    newest = [F.desc(time), F.col(ident)]
    t = ranked(df, [group], newest, 2 * n).drop("rank").withColumn("__ok", succeeded.cast("int"))
    t = t.withColumn("__what", F.when(F.col("__ok") == 0, F.col(ident).cast("string")).otherwise(F.col(context)))
    return ranked(first_per(t, [group, "__what"], newest), [group], [F.col("__ok"), *newest], n).select(group, ident)


def by_priority(column: str, levels: list[str]) -> Column:
    """Place of a value in the list of levels; others last."""
    out = F.lit(len(levels) + 1)
    for i, level in reversed(list(enumerate(levels, 1))):
        out = F.when(F.col(column) == level, i).otherwise(out)
    return out


def upserted(old: DataFrame, given: DataFrame) -> DataFrame:
    """old(name, entity_type, access_count, current_version, observations) after the batch given(name, entity_type, at, observations), with op.

    Observations are counts here. Rows of one name are taken in the order of
    ``at``: the first inserts an unknown name (no access, version 1), each other
    one counts an access and a version; the last gives the type; observations
    add up. Rows without a name fail by themselves and change nothing; names of
    ``old`` are unique; what isn't in the batch is kept.
    """
    n = given.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("at", "entity_type")).alias("last"), F.sum("observations").alias("more"))
    known, times = F.col("current_version").isNotNull(), F.coalesce("times", F.lit(0))
    op = F.when(~known, "insert").when(F.col("times").isNull(), "keep").otherwise("update")
    return old.join(n, "name", "full_outer").select(
        "name",
        F.coalesce("last.entity_type", "entity_type").alias("entity_type"),
        F.when(known, F.col("access_count") + times).otherwise(times - 1).alias("access_count"),
        F.when(known, F.col("current_version") + times).otherwise(times).alias("current_version"),
        (F.coalesce("observations", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("observations"),
        op.alias("op"),
    )
