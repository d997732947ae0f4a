import random

import pytest

from mnemospark.llm._components import components


@pytest.mark.parametrize("few", [0, 60, 100_000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_union_find(spark, seed, few):
    r = random.Random(seed)
    pairs = [(r.randint(0, 200), r.randint(0, 200)) for _ in range([90, 220, 0][seed])]
    if seed == 0:
        pairs += [(i, i + 1) for i in range(1000, 1080)] + [(3000 - i, 2999 - i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = components(spark.createDataFrame(pairs, "a long, b long"), few=few)
    assert {x.id: x.component for x in got.collect()} == {k: find(k) for k in parent}
