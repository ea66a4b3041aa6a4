import hashlib
import math

import numpy as np
import pytest

from starledger.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance double"


def brute(rows, k, rounds, dimensions):
    """Lloyd's rounds with all distances, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    points = [x for _, x in first]
    if not points:
        return []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = [[] for _ in points]
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        points = [[sum(col) // len(xs) for col in zip(*xs, strict=True)] if xs else p for p, xs in zip(points, own, strict=True)]
    placed = [(i, *nearest(x)) for i, x in kept]
    total = {c: sum(d for _, d, e in placed if e == c) for c in range(len(points))}
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, total[c], sum(total.values()), digests[c]) for i, d, c in placed), key=str)


def found(spark, rows, k=8, rounds=10, dimensions=6):
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in orchard.cluster_vectors(table, k, rounds, dimensions).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in rng.permutation(300)]
    assert found(spark, rows) == brute(rows, 8, 10, 6)


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 0.0, -0.0, 1.0, -1.0, 0.5]) for i in range(40)] * 2
    rows += [(100, None), (101, []), (102, [1.0] * 5), (103, [1.0] * 5 + [None]), (104, [nan] + [0.0] * 5), (105, [inf] + [0.0] * 5), (None, [2.0] * 6), (106, [-0.0001] * 6)]
    assert found(spark, rows) == brute(rows, 8, 10, 6)
    few = rows[:2]
    assert found(spark, few) == brute(few, 8, 10, 6)
    assert found(spark, []) == [] and found(spark, rows[80:84]) == []


def test_hot_vector(spark):
    """One vector makes up most of the table."""
    rows = [(i, [0.25] * 6) for i in range(2000)] + [(5000 + i, [math.sin(i * j + 1) for j in range(6)]) for i in range(200)]
    assert found(spark, rows, k=5, rounds=3) == brute(rows, 5, 3, 6)


def test_search_is_exact_and_skips():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (200, 8))
    centroids = orchard.Centroids(np.concatenate([centres, centres[:5]]))  # equal ones too
    x = np.concatenate([centres[rng.integers(0, 200, 3000)] + rng.integers(-40, 40, (3000, 8)), rng.integers(-9000, 9000, (500, 8))])
    cluster, distance, measured = centroids.nearest(x)
    far = ((x[:, None, :] - centroids.points[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    assert measured < 0.5 * far.size


def test_too_large(spark):
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(1, [1e300] * 6), (2, [0.0] * 6)])
