"""Symbolic regression: a population of expression trees, bred on the driver and scored by Spark, a scan a generation.

A tree is a variable, a constant or (operator, tree, tree ...). Each is fitted as
target = intercept + slope * tree by sums that every task adds up for all trees
at once; a row of six numbers a tree and task is summed by Spark and comes back.
What is kept is the front: the best fit of each complexity (nodes of the tree)
that no simpler one reaches.

Edge cases: rows with a null in the target or a variable count for no tree; a
row whose tree isn't finite (a division by zero) is left out for that tree,
which then needs nine tenths of the rows; a constant tree fits nothing; an empty
table has an empty front. The same seed, rows and variables give the same trees.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tree = tuple | str | float

BINARY = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}
UNARY = {"sqrt": lambda x: np.sqrt(np.abs(x)), "log1p": lambda x: np.log1p(np.abs(x)), "square": np.square}
CONSTANTS = (0.5, 1.0, 2.0)
#: Rows that one numpy step works on.
STEP = 8192


def text(tree: Tree) -> str:
    if not isinstance(tree, tuple):
        return str(tree)
    return f"{tree[0]}({text(tree[1])})" if len(tree) == 2 else f"({text(tree[1])} {tree[0]} {text(tree[2])})"


def complexity(tree: Tree) -> int:
    return 1 + sum(map(complexity, tree[1:])) if isinstance(tree, tuple) else 1


def value(tree: Tree, columns: dict[str, np.ndarray]) -> np.ndarray | float:
    if not isinstance(tree, tuple):
        return columns[tree] if isinstance(tree, str) else tree
    return (UNARY if len(tree) == 2 else BINARY)[tree[0]](*(value(t, columns) for t in tree[1:]))


def _settled(tree: Tree) -> Tree:
    """The same tree with the parts of sums and products in one order."""
    if not isinstance(tree, tuple):
        return tree
    parts = [_settled(t) for t in tree[1:]]
    return (tree[0], *(sorted(parts, key=text) if tree[0] in "+*" else parts))


def _grown(r: random.Random, variables: list[str], depth: int) -> Tree:
    if depth == 0 or r.random() < 0.2:
        return r.choice(variables) if r.random() < 0.85 else r.choice(CONSTANTS)
    if r.random() < 0.2:
        return r.choice(list(UNARY)), _grown(r, variables, depth - 1)
    return r.choice(list(BINARY)), _grown(r, variables, depth - 1), _grown(r, variables, depth - 1)


def _places(tree: Tree, at: tuple = ()) -> list[tuple]:
    out = [at]
    for i, t in enumerate(tree[1:], 1) if isinstance(tree, tuple) else ():
        out += _places(t, (*at, i))
    return out


def _get(tree: Tree, at: tuple) -> Tree:
    for i in at:
        tree = tree[i]
    return tree


def _put(tree: Tree, at: tuple, new: Tree) -> Tree:
    return (*tree[: at[0]], _put(tree[at[0]], at[1:], new), *tree[at[0] + 1 :]) if at else new


def scored(rows: DataFrame, target: str, variables: list[str], trees: list[Tree]) -> dict[str, tuple[float, float, float]]:
    """(slope, intercept, r2) of each tree that can be fitted; one scan for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(trees), 6)), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                y, *xs = (c.slice(lo, STEP).to_numpy(zero_copy_only=False) for c in batch.columns)
                columns = dict(zip(variables, xs))
                seen += len(y)
                for k, tree in enumerate(trees):
                    with np.errstate(all="ignore"):
                        x = np.broadcast_to(np.asarray(value(tree, columns), dtype=np.float64), y.shape)
                    good = np.isfinite(x) & (np.abs(x) < 1e150)
                    x, z = x[good], y[good]
                    sums[k] += len(x), x.sum(), z.sum(), x @ x, x @ z, z @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), pa.array(np.full(len(trees), seen)), *(pa.array(c) for c in sums.T)], names=["tree", "seen", *"abcdef"])

    found = rows.select(target, *variables).mapInArrow(run, "tree long, seen long, " + ", ".join(f"{c} double" for c in "abcdef"))
    out = {}
    for r in found.groupBy("tree").agg(*(F.sum(c).alias(c) for c in ("seen", *"abcdef"))).collect():  # a row a tree
        n, sx, sy, sxx, sxy, syy = (r[c] for c in "abcdef")
        if n < 2 or n < 0.9 * r.seen:
            continue
        vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        if vx > 1e-12 * max(sxx, 1e-300) and vy > 0:
            slope = cov / vx
            out[text(trees[r.tree])] = slope, (sy - slope * sx) / n, min(1.0, cov * cov / (vx * vy))
    return out


def evolved(df: DataFrame, target: str, variables: list[str], most: int = 15, population: int = 150, generations: int = 10, seed: int = 3, enough: float = 1 - 1e-9) -> DataFrame:
    """(expression, complexity, slope, intercept, r2): the front of what ``generations`` of trees of up to ``most`` nodes have found.

    The first generation has all pairs of variables under each operator and
    random trees; the second joins the better ones with each variable; each next
    one is bred from the better ones by crossing and changing parts, and keeps
    the front. It ends early where a tree explains ``enough``.
    """
    spark = df.sparkSession
    names = [target, *variables]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in names))
    r = random.Random(seed)
    fresh = [*variables, *((o, a, b) for o in BINARY for a in variables for b in variables), *((u, a) for u in UNARY for a in variables)]
    while len(fresh) < population:
        fresh.append(_grown(r, variables, 3))
    known: dict[str, tuple] = {}  # trees tried, with their fit
    tried: set[str] = set()
    for generation in range(generations):
        new = {text(t): t for t in map(_settled, fresh) if complexity(t) <= most and text(t) not in tried}
        tried |= set(new)
        if new:
            fits = scored(rows, target, variables, list(new.values()))
            known |= {k: (new[k], *fit) for k, fit in fits.items()}
        if not known:
            break
        ranked = sorted(known.items(), key=lambda x: (-round(x[1][3] - 0.001 * complexity(x[1][0]), 9), complexity(x[1][0]), x[0]))[:population]
        if ranked[0][1][3] >= enough:
            break
        pool = [v[0] for _, v in ranked]
        pick = lambda: pool[min(r.randrange(len(pool)), r.randrange(len(pool)))]
        fresh = []
        if generation == 0:  # every formula of two operators is near to one of them
            few = sorted((t for t in pool if complexity(t) <= 3), key=lambda t: -known[text(t)][3])[: max(48, population // 4)]
            fresh = [(o, *pair) for t in few for v in variables for o in BINARY for pair in ((t, v), (v, t))] + [(u, t) for t in few for u in UNARY]
        while len(fresh) < population:
            tree = pick()
            at = r.choice(_places(tree))
            part = _get(pick(), ()) if r.random() < 0.2 else None
            if part is None:
                giver = pick()
                part = _get(giver, r.choice(_places(giver))) if r.random() < 0.6 else _grown(r, variables, 2)
            fresh.append(_put(tree, at, part))
    front, best = [], -1.0
    for name, (tree, slope, intercept, r2) in sorted(known.items(), key=lambda x: (complexity(x[1][0]), -round(x[1][3], 9), x[0])):
        if round(r2, 9) > best:
            best = round(r2, 9)
            front.append((name, complexity(tree), slope, intercept, r2))
    return spark.createDataFrame(front, "expression string, complexity int, slope double, intercept double, r2 double")
