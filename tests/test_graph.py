"""Budgeted searches against a sequential one."""

import random
from collections import deque

import pytest

from tarnwick.operators import graph


def sequential(edges, pages, seed, depth):
    name, page, target, key, scope, budget = seed
    if budget is None or budget < 1:
        return []
    out, seen, queue = [(name, key, target, 0, 1, None)], {key}, deque([(page, target, 0)])
    while queue:
        at, source, d = queue.popleft()
        if d == depth:
            continue
        for _, k, t, s in sorted((pos, k, t, s) for p, pos, t, k, s in edges if p == at and at is not None):
            if len(out) < budget and k not in seen and (scope is None or s == scope):
                seen.add(k)
                out.append((name, k, t, d + 1, len(out) + 1, source))
                queue.append((pages.get(k), t, d + 1))
    return out


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_equals_a_sequential_search(spark, depth):
    rng = random.Random(depth)
    keys = [f"k{i}" for i in range(60)]
    pages = {k: i for i, k in enumerate(keys) if i % 7}  # some keys have no page
    edges = [(p, pos, f"t{rng.randrange(3)}{k}", k, "a" if int(k[1:]) % 4 else "b") for p in range(60) for pos, k in enumerate(rng.choices(keys, k=rng.randrange(9)))]
    # a hub that all link to, and pages that link to themselves
    edges += [(p, 20, "hub", "k1", "a") for p in range(60)] + [(p, 21, "self", f"k{p}", "a") for p in range(60)]
    seeds = [(f"s{b}", rng.randrange(60), f"root{b}", keys[b], rng.choice(["a", "b", None]), b) for b in range(51)] + [("none", 3, "x", "k3", "a", None)]
    got = graph.trees(
        spark.createDataFrame(edges, "page int, pos int, target string, key string, scope string").repartition(3),
        spark.createDataFrame(list(pages.items()), "key string, page int"),
        spark.createDataFrame(seeds, "seed string, page int, target string, key string, scope string, budget int"),
        depth,
    )
    want = [r for s in seeds for r in sequential(edges, pages, s, depth)]
    assert sorted(map(tuple, got.select("seed", "key", "target", "depth", "rank", "parent").collect())) == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3], r[4], r[5] or ""))


def test_no_seeds(spark):
    none = spark.createDataFrame([], "seed string, page int, target string, key string, scope string, budget int")
    edges = spark.createDataFrame([(1, 1, "t", "k", None)], "page int, pos int, target string, key string, scope string")
    assert graph.trees(edges, spark.createDataFrame([("k", 1)], "key string, page int"), none, 3).collect() == []
