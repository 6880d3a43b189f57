import random

from tunelake.llm.graph import components


def test_components_of_chains_stars_and_noise(spark):
    draw = random.Random(1)
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (5, 4), (5, 4)]
    edges += [(draw.randint(1000, 1200), draw.randint(1000, 1200)) for _ in range(120)] + [(-(1 << 60), 1 << 60)]
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    found = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in parent} == {n: top(n) for n in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
