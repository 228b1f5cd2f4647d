"""The stored near-duplicate index against one exact pass, in batches and with hot groups."""

import random

import pytest

from tarnwick.operators import lsh


def exact(rows, threshold=0.75):
    kept = []
    for i, w in sorted((i, frozenset(w)) for i, w in rows):
        if not any(w and len(w & v) >= threshold * len(w | v) for _, v in kept):
            kept.append((i, w))
    return [i for i, _ in kept]


def corpus(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(n // 5)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 2, 5, 9, 30])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append((i, w))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_batches_give_the_result_of_one_pass(spark, tmp_path, batches):
    rows = corpus(300, 5) + [(1000, []), (1001, []), (1002, None)]
    index, got = lsh.LshIndex(spark, f"file://{tmp_path}/i"), []
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], "id int, w array<string>").where("w is not null")
        got += [r.id for r in index.add(part).collect()]
    want = exact([r for r in rows if r[1] is not None])
    # recall: of what the exact pass drops nearly all is dropped, and nothing else
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.02 * (len(rows) - len(want))
    assert sorted(got) == sorted(set(got))


def test_matches_name_the_stored_row(spark, tmp_path):
    rows = corpus(40, 6)
    index = lsh.LshIndex(spark, f"file://{tmp_path}/i")
    assert index.matches(spark.createDataFrame(rows, "id int, w array<string>")).collect() == []
    kept = {r.id for r in index.add(spark.createDataFrame(rows, "id int, w array<string>")).collect()}
    probes = [(i + 100, w) for i, w in rows]
    pairs = {(r.a, r.b) for r in index.matches(spark.createDataFrame(probes, "id int, w array<string>")).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, w in rows if i in kept for j, v in probes if jaccard(w, v) >= 0.75}
    assert pairs <= want and len(pairs) >= 0.9 * len(want) and want


def test_a_group_of_near_copies_is_linear_and_unlike_rows_of_a_bucket_are_paired(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, base[: 80 - rng.randrange(3)] + [f"y{i}"]) for i in range(1500)]
    index = lsh.LshIndex(spark, f"file://{tmp_path}/a")
    assert [r.id for r in index.add(spark.createDataFrame(rows, "id int, w array<string>").repartition(4)).collect()] == [0]
    monkeypatch.setattr(lsh, "ROUNDS", 1)
    few = corpus(120, 7)
    got = [r.id for r in lsh.LshIndex(spark, f"file://{tmp_path}/b").add(spark.createDataFrame(few, "id int, w array<string>")).collect()]
    assert sorted(got) == exact(few)


def test_an_empty_batch(spark, tmp_path):
    index = lsh.LshIndex(spark, f"file://{tmp_path}/e")
    assert index.add(spark.createDataFrame([], "id int, w array<string>")).collect() == []
    assert index.add(spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (None, ["a"])], "id int, w array<string>")).count() == 1


def test_sets_travel_only_for_candidates(spark, tmp_path):
    """Unlike rows that share frequent words cost their bands, not their sets."""
    rng = random.Random(12)
    rows = [(i, [f"common{k}" for k in range(60)] + [f"w{rng.randrange(10**9)}" for _ in range(340)]) for i in range(800)]
    batch, sc = spark.createDataFrame(rows, "id int, w array<string>").repartition(4), spark._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    batch.write.format("noop").mode("overwrite").save()
    before = written()
    batch.write.format("noop").mode("overwrite").save()
    once = written() - before
    assert lsh.LshIndex(spark, f"file://{tmp_path}/t").add(batch).count() == 800
    assert written() - before - once < 2 * once
