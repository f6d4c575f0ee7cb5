import random

import pytest

from leadloom.operators.graph import connected_components
from leadloom.scratch import Scratch


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("finish", [0, 500, 100_000])
def test_components(spark, finish):
    rng = random.Random(finish)
    path = [(i, i + 1) for i in range(300)]
    star = [(10_000, i) for i in range(10_001, 10_400)]
    noise = [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(600)]
    edges = path + star + noise + path[:5] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long").repartition(5)
    found = connected_components(df, Scratch(spark, "cc"), finish=finish).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert len(found) == len({r.node for r in found})
    assert {frozenset(g) for g in groups.values()} == brute([e for e in edges if e[0] != e[1]])


def test_strings_and_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert len({r.root for r in connected_components(df, Scratch(spark, "cc"), finish=0).collect()}) == 1
    assert connected_components(df.limit(0), Scratch(spark, "cc")).collect() == []


def test_scratch_folders_go(spark):
    import os

    from leadloom.scratch import Scratch

    one, two = Scratch(spark, "one"), Scratch(spark, "two")
    tables = [s.save(spark.range(3).toDF("x"), "t") for s in (one, two)]
    assert [t.count() for t in tables] == [3, 3]
    one.drop(tables[0])
    one.close()
    assert not os.path.exists(one.root) and os.path.exists(two.root)
    two.close()
    assert not os.path.exists(two.root)
