"""Connected components of an edge table, by hooking and contraction in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import dropped, staged

#: Edges that one task settles by itself (a few MB); more of them are contracted in rounds first.
FEW_EDGES = 100_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (id, component) of their ends, by union and find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """edges(a, b) -> (id, component): for every id of an edge, the smallest id that it reaches.

    In a round every node hooks to its smallest smaller neighbour, chains of
    hooks are shortened by pointer jumping, and the edges are contracted to
    edges between the hooks' ends; what is inside one end is gone. The edges
    left shrink from round to round, each of which is written to the shared
    folder; the last ``few`` of them are one task's work.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return staged(df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

    def settled(df: DataFrame) -> DataFrame:
        return df.coalesce(1).mapInArrow(_settle, "id long, component long")

    left = tidy(edges.select("a", "b"))
    n = left.count()
    if n <= few:
        label = staged(settled(left), name)
        dropped(left)
        return label
    label = staged(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), name)
    while n > few:
        hooks = held = staged(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), name)
        while True:
            above = hooks.select(F.col("id").alias("up"), F.col("up").alias("above"))
            jumped = staged(hooks.join(above, "up", "left").select("id", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), name)
            dropped(held)
            hooks, held = jumped.select("id", "up"), jumped
            if jumped.where("moved").isEmpty():
                break
        old, label = label, staged(label.join(hooks.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), name)
        a, b = (hooks.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        before, left = left, tidy(left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")))
        dropped(before, held, old)
        n = left.count()
    if n:
        last = settled(left).select(F.col("id").alias("component"), F.col("component").alias("up"))
        old, label = label, staged(label.join(last, "component", "left").select("id", F.coalesce("up", "component").alias("component")), name)
        dropped(old)
    dropped(left)
    return label
