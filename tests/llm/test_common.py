import random

import pytest

from pixelweft.llm import common


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_EDGES", small)
    r = random.Random(small)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(30)] + [(5000, k) for k in range(2000, 2100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = {row.node: row.component for row in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert common.components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0
