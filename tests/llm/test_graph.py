"""Components of links in one partition and over many."""

import random

import numpy as np
import pytest

from dupscope.llm import graph


def smallest(edges):
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


def cases():
    rng = random.Random(1)
    return {
        "none": [],
        "loops": [(3, 3), (4, 4), (4, 5)],
        "path": [(i, i + 1) for i in rng.sample(range(300), 300)],
        "hub": [(7, i) for i in range(1000, 1300)] + [(5, 1299), (7, 7)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] * 2,
    }


@pytest.mark.parametrize("size", [40, 1 << 21])
@pytest.mark.parametrize("name", cases())
def test_components(spark, monkeypatch, size, name):
    monkeypatch.setattr(graph, "PER_TASK", size)
    edges = cases()[name]
    want = smallest([e for e in edges if e[0] != e[1]])
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_roots():
    nodes, top = graph.roots(np.array([5, 9, -2, 5]), np.array([9, 7, -2, 5]))
    assert dict(zip(nodes.tolist(), top.tolist())) == {5: 5, 7: 5, 9: 5, -2: -2}
