import random

import pytest

from loomsearch.llm.components import components


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("pairs", [
    [], [(1, 1)], [(2, 1), (1, 2), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, 99) for i in range(50)], [(random.Random(1).randint(0, 60), k) for k in range(60)],
    [(random.Random(k).randint(0, 200), random.Random(k + 999).randint(0, 200)) for k in range(150)], [(-(2**63), 2**63 - 1), (0, -(2**63))],
])
def test_against_union_find(spark, pairs):
    df = spark.createDataFrame(pairs, "u long, v long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == brute([p for p in pairs if p[0] != p[1]])


def test_null_ends_are_ignored(spark):
    assert components(spark.createDataFrame([(1, None), (None, None), (1, 2)], "u long, v long")).count() == 1
