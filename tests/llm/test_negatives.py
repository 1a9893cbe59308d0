"""Hard negatives against a brute-force version, with bounds that prune, ties, repeated rows and numbers of any size."""

import math
import random


def plain(rows, anchors, k=5, low=80):
    """rows, anchors: (vec_id, label, vector)."""
    good = lambda r: None not in r and all(e is not None and math.isfinite(e) for e in r[2])
    whole = lambda x: [math.floor(e * 256) if abs(e) < 2.0**1000 else int(e) * 256 for e in x]
    hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    v = [(i, label, whole(x)) for i, label, x in filter(good, rows)]
    out = []
    for i, label, x in [(i, label, whole(x)) for i, label, x in filter(good, anchors)]:
        scored = [(-hold(sum(a * b for a, b in zip(x, y))), j, other) for j, other, y in v if len(y) == len(x)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label and s[1] != i)[:k]:
            fit = sorted(s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= 100 * -ps)[:k]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def found_of(spark, rows, anchors, **more):
    from ledgerline.llm.negatives import hard_negatives

    kinds = "vec_id long, label int, embedding array<double>"
    made = [spark.createDataFrame(r, kinds).selectExpr("*", "1 AS list", "'x' AS x", "2 AS ask", "3 AS dim") for r in (rows, anchors)]
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives(*made, **more).collect())


def test_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 2), [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    rows += rows[:30]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (500, None, [1.0, 1.0, 1.0]), (501, 1, None), (502, 1, [1.0, None, 1.0]), (503, 1, [float("nan"), 1.0, 1.0]), (504, 1, [float("inf"), 1.0, 1.0])]
    rows += [(600 + i, i % 2, []) for i in range(4)] + [(700 + i, i % 2, [2.0**40 + i, 1.0]) for i in range(6)] + [(800 + i, i % 2, [1e308]) for i in range(4)]
    anchors = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    assert found_of(spark, rows, anchors) == plain(rows, anchors)
    assert found_of(spark, [], []) == []
    assert found_of(spark, rows, []) == []


def test_lists_that_bounds_rule_out(spark, monkeypatch):
    """Tight clusters far apart: some visits are saved and nothing is lost; small blocks cut every list."""
    from ledgerline.llm import negatives

    monkeypatch.setattr(negatives, "BLOCK", 8 * 2 * 64)
    monkeypatch.setattr(negatives, "ROUND", 1 << 12)
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 1), [math.cos(i % 40) * 9 + rng.gauss(0, 0.01), math.sin(i % 40) * 9 + rng.gauss(0, 0.01)]) for i in range(4000)]
    anchors = rows[::100]
    assert found_of(spark, rows, anchors, low=99) == plain(rows, anchors, low=99)


def test_bounds_hold_and_save_visits():
    import numpy as np

    from ledgerline.llm import negatives as n

    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 2))[rng.integers(0, 20, 2000)] * 50 + rng.normal(size=(2000, 2)) * 0.1
    q = n.quantised(x)
    at = n.centroids(q, 20)
    near = n.nearest(q, at)
    radius = np.array([np.sqrt(((q[near == i] - c) ** 2).sum(axis=1)).max(initial=0) for i, c in enumerate(at)])
    low, high = n.bounds(q[:50], at, radius)
    own = n.scores(x[:50], x)
    assert (own <= high[:, near]).all() and (own >= low[:, near]).all()
    bar = np.sort(own, axis=1)[:, -5:-4]
    asked = n.Asked(np.arange(50), np.arange(50), np.zeros(50), x[:50], bar, np.full((50, 1), n.MOST))
    chosen = n.visits(asked, at, radius, 0) | n.visits(asked, at, radius, 1)
    assert chosen.mean() < 0.5 and all(chosen[i, near[np.argsort(-own[i])[:5]]].all() for i in range(50))
