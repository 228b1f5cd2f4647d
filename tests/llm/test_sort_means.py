"""Sort-means against plain k-means over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import sort_means

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, size=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2**20 for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [v for _, v in first]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((d(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if r < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = {j: sum(x for x, c in near if c == j) for j in range(len(cents))}
    return sorted(((i, c, x, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (x, c) in zip(kept, near, strict=True)), key=repr)


def clustered(spark, rows, **how):
    return sorted((tuple(r) for r in sort_means.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()), key=repr)


def test_equals_plain_k_means(spark):
    rng = random.Random(3)
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centers)]) for i in range(400)]
    assert clustered(spark, rows) == brute(rows)


def test_bad_vectors_ties_and_repeats(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5])] * 64) for i in range(120)] + [(500, [0.25] * 64)] * 40  # many equal distances
    rows += [(None, [0.1] * 64), (None, [0.1] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [nan]), (906, [-inf] + [1.0] * 63), (907, [3e38] * 64), (908, [2.0**20] * 64), (909, [-1048575.9] * 64)]
    assert clustered(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert clustered(spark, rows) == brute(rows)
    assert clustered(spark, []) == [] and clustered(spark, [(1, [1.0])]) == []


def test_other_columns_are_not_read(spark):
    rows = [(i, [float(i % 7)] * 64) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "cluster", "distance", "n", "i", "s", "h", "inertia")})
    assert sorted((tuple(r) for r in sort_means.cluster(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("start", [0, 1])
def test_looks_end_early_and_miss_nothing(start):
    rng = np.random.default_rng(5)
    centroids = rng.integers(-40, 40, (16, 8)) * 10
    v = centroids[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 8))
    d = ((v[:, None] - centroids[None]) ** 2).sum(-1)
    before = d.argmin(1) if start else np.zeros(2000, np.int64)
    cluster, distance, taken = sort_means.assign(v, before, centroids)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    if start:  # settled vectors look at few of the 16 centroids
        assert taken < 2000 * 8
    # just at twice the distance an equal, smaller centroid still wins
    got = sort_means.assign(np.array([[5, 0]]), np.array([1]), np.array([[10, 0], [0, 0]]))
    assert (got[0][0], got[1][0]) == (0, 25)
