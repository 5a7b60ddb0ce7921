"""Connected components against a walk through the links."""

from __future__ import annotations

import random

import pytest

from lodestone.llm.graph import components


def walked(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in root:
                root[node] = start
                todo += near[node]
    return sorted(root.items())


_any = random.Random(5)
GRAPHS = {
    "none": [],
    "a node with itself": [(3, 3)],
    "stars, twice": [(1, 2), (3, 1), (1, 2), (9, 7)],
    "a hub that is not the least": [(50, k) for k in range(100)],
    "a path": [(k, k + 1) for k in range(40)],
    "a zigzag with negative ids": [(k, -k) for k in range(1, 30)] + [(-k, k + 1) for k in range(1, 29)],
    "chance": [(_any.randrange(300), _any.randrange(300)) for _ in range(220)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == walked(GRAPHS[name])
