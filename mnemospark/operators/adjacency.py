"""Graphs of a checked size as arrays that a task can hold, and searches in them.

Operators on edge tables count their edges first: up to ``MAX_EDGES`` the graph
is broadcast in this form (about 12 bytes an edge) and each task searches from
its own seeds; larger graphs are joined level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Directed edges up to which a graph is broadcast or one task's work.
MAX_EDGES = 2_000_000


class Adjacency:
    """Nodes in ascending order; the successors of the i-th are heads[start[i]:start[i + 1]], ascending (all by place)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.nodes = np.unique(np.concatenate([a, b]))
        self._fill(np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b))

    def _fill(self, tails: np.ndarray, heads: np.ndarray) -> None:
        order = np.lexsort((heads, tails))
        self.start = np.searchsorted(tails[order], np.arange(len(self.nodes) + 1))
        self.heads = heads[order].astype(np.int32)

    def reversed(self) -> Adjacency:
        out = object.__new__(Adjacency)
        out.nodes = self.nodes
        out._fill(self.heads.astype(np.int64), np.repeat(np.arange(len(self.nodes)), np.diff(self.start)))
        return out

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids; -1 for ids without edges."""
        at = np.minimum(np.searchsorted(self.nodes, ids), max(len(self.nodes) - 1, 0))
        return np.where(self.nodes[at] == ids, at, -1) if len(self.nodes) else np.full(len(ids), -1)

    def of(self, place: int) -> np.ndarray:
        return self.heads[self.start[place] : self.start[place + 1]]

    def step(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tails, heads) of all edges that leave the frontier, in its order."""
        size = self.start[frontier + 1] - self.start[frontier]
        at = np.arange(int(size.sum())) + np.repeat(self.start[frontier] - (np.cumsum(size) - size), size)
        return np.repeat(frontier, size), self.heads[at]

    def levels(self, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes first reached, the smallest node of the level before that leads to each), level by level from 1."""
        seen = np.zeros(len(self.nodes), bool)
        seen[seed] = True
        frontier = np.array([seed])
        while len(frontier):
            tails, heads = self.step(frontier)
            fresh = ~seen[heads]
            frontier, first = np.unique(heads[fresh], return_index=True)
            seen[frontier] = True
            if len(frontier):
                yield frontier, tails[fresh][first]


def broadcast(edges: DataFrame, most: int = MAX_EDGES) -> Broadcast | None:
    """The graph of a staged table of distinct edges(a, b), if their ids are integers and it has ``most`` edges at most."""
    if most < 0 or not all(isinstance(edges.schema[c].dataType, T.IntegralType) for c in ("a", "b")):
        return None
    table = edges.select(edges.a.cast("long"), edges.b.cast("long")).limit(most + 1).toArrow()  # one more would be too many
    if table.num_rows > most:
        return None
    return edges.sparkSession.sparkContext.broadcast(Adjacency(table.column(0).to_numpy(), table.column(1).to_numpy()))


def longs(*columns: np.ndarray | list) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]
