import random

from tidemark.llm import components


def test_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in edges], "a binary, b binary")
    got = {int(r["node"]): int(r["root"]) for r in components.components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty(spark):
    assert components.components(spark.createDataFrame([], "a binary, b binary")).count() == 0
