import random

from bough.llm import shared


def test_components(spark):
    dice = random.Random(2)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = {(r["node"], r["component"]) for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
