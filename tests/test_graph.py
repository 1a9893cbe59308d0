"""Connected components against a plain union of sets."""

import random

from ledgerline.operators.graph import connected


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (200, 201)]
    groups = {}
    for a, b in edges:
        if a != b:
            one, two = groups.setdefault(a, {a}), groups.setdefault(b, {b})
            if one is not two:
                one |= two
                for x in two:
                    groups[x] = one
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: min(own) for x, own in groups.items()}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
