import random

from lagscope.llm.components import components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent if find(x) != x}


def test_against_union_find(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(-20, 40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    edges = [*path, *star, *loose, (7, 7), (9000, 9000), (-(1 << 63), (1 << 63) - 1)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
