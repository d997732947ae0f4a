"""Enhanced suffix arrays in numpy: bounded-depth suffix sorting, LCP values and the tree of LCP intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each key; ranks begin at 1)."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    step = np.ones(len(keys), np.int64)
    if len(keys):
        step[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


class SuffixArray:
    """Suffixes of ``values``, sorted by their first ``depth`` values at least (prefix doubling).

    ``unit``: how many values a key holds, if ``keys`` (one for each position)
    are given instead of single values. A suffix that ends sorts first.
    ``order`` is the suffix array, ``lcp[i]`` the common prefix of order[i - 1]
    and order[i], in steps of ``unit`` (exact for unit 1).
    """

    def __init__(self, keys: np.ndarray, depth: int, unit: int = 1):
        self.unit, n = unit, len(keys)
        order, rank = _dense(keys)
        self.levels = [rank]
        span = unit
        while span < depth and n and rank.max() < n:
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - span)] = rank[span:]
            order, rank = _dense(rank * (n + 1) + nxt)
            self.levels.append(rank)
            span *= 2
        self.order, self.span = order, span

    def lcp(self) -> np.ndarray:
        """Also of a subset of the suffixes, if ``order`` was reduced to one."""
        n = len(self.levels[0])
        out = np.zeros(len(self.order), np.int64)
        if len(out) < 2:
            return out
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        got = np.zeros(len(out) - 1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], self.unit << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                on = (a < n) & (b < n)
                same = on.copy()
                same[on] = rank[a[on]] == rank[b[on]]
                got[same] += step
                a[same] += step
                b[same] += step
        out[1:] = got
        return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(left, right, length) of every LCP interval of length >= least: a stack scan.

    left..right are places of the suffix array whose suffixes share exactly
    ``length`` leading values as their longest common prefix.
    """
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
        values = lcp[run]
        begin, end = int(run[0]) - 1, int(run[-1])
        if (values == values[0]).all():
            yield begin, end, int(values[0])
            continue
        stack: list[tuple[int, int]] = []  # (length, left)
        for i, v in zip(run.tolist(), values.tolist()):
            left = i - 1
            while stack and stack[-1][0] > v:
                length, left = stack.pop()
                yield left, i - 1, length
            if not stack or stack[-1][0] < v:
                stack.append((v, left))
        while stack:
            length, left = stack.pop()
            yield left, end, length


def left_diverse(before: np.ndarray) -> bool:
    """Whether the values before the occurrences differ, so that the repeat can't be extended to the left. A negative value (start of a text) differs from all."""
    return bool(before[0] < 0 or (before != before[0]).any() or (before < 0).any())
