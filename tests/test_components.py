"""Connected components against union-find."""

import random

import pytest

from loomline.operators.components import connected_components
from tests.conftest import rows


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(parent))


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 200 + i) for i in range(30)]
    assert rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))) == sorted(union_find(edges), key=repr)


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([], "a bigint, b bigint"))) == []
