import random

from oremill.llm.components import components, local_roots
from oremill.llm.shared import Stage


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


def test_matches_union_find(spark):
    r = random.Random(2)
    edges = [(g, r.randrange(200), r.randrange(200)) for g in (0, 1) for _ in range(120)] + [(2, i, i + 1) for i in range(60)] + [(3, 5, 5)]
    got = components(spark.createDataFrame(edges, "g int, a long, b long").repartition(7), Stage(spark)).collect()
    for g in range(4):
        assert {a: b for k, a, b in got if k == g} == roots([(a, b) for k, a, b in edges if k == g])
    assert len({(g, a) for g, a, _ in got}) == len(got)
    assert components(spark.createDataFrame([], "g int, a long, b long"), Stage(spark)).collect() == []


def test_local_roots_chain():
    import numpy as np

    nodes, root = local_roots(np.arange(1, 50), np.arange(0, 49))
    assert (root == 0).all() and len(nodes) == 50
