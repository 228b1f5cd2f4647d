"""The similarity join's parts against brute force: tiles of hot numbers, large sets, and the bytes that it deals out."""

import random

import numpy as np
import pyarrow as pa

from tarnwick.operators import dedup, similar


def alike(sets, t=0.75):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def candidates(sets, large=False):
    """The pairs that the tasks leave, without Spark."""
    c, w = sorted(sets), [np.array(sorted(sets[c]), np.int64) for c in sorted(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(w, pa.list_(pa.int64()))], names=["c", "w"])
    counts = np.bincount(np.concatenate(w) & (similar.SKETCH - 1), minlength=similar.SKETCH)
    rows = pa.Table.from_batches(list(similar.prefixes(0.75, lambda: similar._coded(counts).tobytes())(iter([batch]))))
    rows = rows.sort_by([("key", "ascending"), ("n", "ascending")])
    cells = [b for x in similar.cells_of(similar.HELD)(iter([batch])) for b in x.column(1).to_pylist()]
    held = (np.array(c, np.int64).tobytes(), b"".join(cells)) if large else (b"", b"")
    out = similar.meetings(0.75, lambda: held)(iter(rows.to_batches(max_chunksize=17)))
    return {(x, y) for b in out for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


def corpus(n, size, seed, words=1 << 62):
    rng = random.Random(seed)
    base = [[rng.randrange(words) for _ in range(size)] for _ in range(n // 4)]
    out = {}
    for i in range(n):
        w = set(rng.choice(base))
        for x in rng.sample(sorted(w), rng.randrange(len(w) // 5 + 1)):
            w.discard(x)
            w.add(rng.randrange(words))
        out[i] = w
    return out


def test_no_similar_pair_is_lost(monkeypatch):
    for size, words in ((1, 5), (4, 30), (40, 1 << 62), (40, 200)):
        sets = corpus(120, size, size, words)
        assert alike(sets) <= candidates(sets)
    monkeypatch.setattr(similar, "HOT", 4)  # every number in tiles
    sets = corpus(120, 30, 3, 100)
    assert alike(sets) <= candidates(sets) and alike(sets)


def test_large_sets_that_share_rare_words_are_told_apart_before_they_are_dealt_on():
    rng = random.Random(4)
    common = [rng.randrange(1 << 62) for _ in range(300)]
    sets = {i: {*common, *(rng.randrange(1 << 62) for _ in range(900))} for i in range(40)}
    for i in range(40):
        sets[i] |= {7 + i // 2 * 1000, 11}
    sets[40] = {*list(sets[0])[:1150]}
    assert candidates(sets, large=True) == alike(sets) == {(0, 40)}


def test_few_bytes_are_dealt_for_a_word(spark):
    """A word of a set costs some bytes of shuffle, not a row with its text, signature and twice its places."""
    rng = random.Random(11)
    vocabulary = [f"word{int(rng.paretovariate(0.5)) % 50_000}" for _ in range(200_000)]
    rows = [(i, sorted({*rng.sample(vocabulary, 300)})) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(4)
    sc = spark._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    df.write.format("noop").mode("overwrite").save()
    before = written()
    dedup.similar_sets(df, "id", "w", 0.75).collect()
    assert 0 < written() - before < 30 * sum(len(w) for _, w in rows)
