"""Symbolic regression by generations: planted formulas are found, scores equal plain least squares."""

import random

import numpy as np
import pytest

from mnemospark.operators import equations as E


def table(spark, f, n=400, seed=5):
    r = random.Random(seed)
    rows = [(x, y, z, float(f(x, y, z))) for x, y, z in ((r.uniform(0.2, 2), r.uniform(0.2, 2), r.uniform(0.2, 2)) for _ in range(n))]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)], "x double, y double, z double, t double")


@pytest.mark.parametrize("name, f", [("product over", lambda x, y, z: 1.5 + 2 * x * y / z), ("difference times", lambda x, y, z: 3 - x * (y - z)), ("root of a sum", lambda x, y, z: (x + z) ** 0.5 * 4)])
def test_planted_formulas_are_found(spark, name, f):
    front = E.evolved(table(spark, f), "t", ["x", "y", "z"]).collect()
    best = front[-1]
    assert best.r2 > 1 - 1e-9 and best.complexity <= 7
    assert [r.complexity for r in front] == sorted({r.complexity for r in front}) and all(a.r2 < b.r2 for a, b in zip(front, front[1:]))
    again = E.evolved(table(spark, f).repartition(3), "t", ["x", "y", "z"]).collect()
    assert [(r.expression, round(r.r2, 8)) for r in again] == [(r.expression, round(r.r2, 8)) for r in front]


def test_scores_equal_least_squares(spark):
    df = table(spark, lambda x, y, z: x + y * y + np.sin(9 * z))
    trees = ["x", ("*", "x", "y"), ("/", "z", ("-", "x", 1.0)), ("sqrt", ("+", "y", "y")), 2.0, ("/", 1.0, ("-", "x", "x"))]
    got = E.scored(df.where("x IS NOT NULL AND t IS NOT NULL"), "t", ["x", "y", "z"], trees)
    rows = np.array([tuple(r) for r in df.where("x IS NOT NULL AND t IS NOT NULL").collect()])
    columns = dict(zip("xyz", rows.T))
    assert set(got) == {E.text(t) for t in trees[:4]}  # a constant and a division by zero fit nothing
    for tree in trees[:4]:
        v = E.value(tree, columns)
        slope, intercept = np.polyfit(v, rows[:, 3], 1)
        assert np.allclose(got[E.text(tree)], (slope, intercept, np.corrcoef(v, rows[:, 3])[0, 1] ** 2), rtol=1e-6, atol=1e-9)


def test_a_scan_a_generation(spark, monkeypatch):
    scans = []
    real = E.scored
    monkeypatch.setattr(E, "scored", lambda rows, t, v, trees: scans.append(len(trees)) or real(rows, t, v, trees))
    E.evolved(table(spark, lambda x, y, z: np.sin(40 * x) + np.cos(50 * y)), "t", ["x", "y", "z"], population=40, generations=3)
    assert len(scans) == 3 and max(scans) <= 1500
    assert E.evolved(table(spark, lambda x, y, z: x).limit(0), "t", ["x"]).count() == 0
