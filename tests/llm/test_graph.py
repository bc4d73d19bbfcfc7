"""Connected components against a search over neighbours."""

import random

import pytest

from codeloom.llm.graph import components


def reached(edges):
    """The smallest node that each node reaches."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        front = [] if start in root else [start]
        while front:
            node = front.pop()
            if node not in root:
                root[node] = start
                front += near[node]
    return root


@pytest.mark.parametrize("kind", ["random", "star", "path", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    if kind == "random":
        edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(220)]
    elif kind == "star":  # one centre has nearly all edges, and is not the smallest node
        edges = [(5000, i) for i in range(1500)] + [(i, i + 1) for i in range(6000, 6010)] + [(5000, 6003)]
    else:
        edges = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(60)] if kind == "path" else []
    given = [*edges, *edges[:5], *[(b, a) for a, b in edges[:5]], *[(a, a) for a, _ in edges[:3]], (None, 1), (2, None)]
    found = components(spark.createDataFrame(given, "a long, b long").repartition(4)).collect()
    assert {r.node: r.root for r in found} == reached([e for e in edges if e[0] != e[1]])
    assert len(found) == len({r.node for r in found})
