"""The quality classifier: held-out accuracy, features against a plain scanner, defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import queries, subwords

DATA = "/root/testdata/sf0.1"


def test_features_equal_a_plain_scanner():
    texts = ["Grüße an an an Zoë", "", "x", "a b\ta b \n", "langeswort" * 30, "𝒳 🙂🙂 e"]
    words = subwords.Words()
    ids, off = words.number(texts)
    names = words.fresh()
    hashes, buckets, first = subwords.word_features(names)
    assert names == list(dict.fromkeys(w for t in texts for w in t.split())) and len(set(hashes.tolist())) == len(names)
    for k, w in enumerate(names):
        marked = f"<{w}>"
        grams = [marked[i : i + n] for n in subwords.GRAMS for i in range(len(marked) - n + 1)]
        own = buckets[first[k] : first[k + 1]]
        assert len(own) == 1 + len(grams)
        alone = subwords.word_features([w])
        assert sorted(alone[1]) == sorted(own) and alone[0][0] == hashes[k]  # a word's features don't hang on its neighbours
    pairs, at = subwords.pair_buckets(hashes[ids], off)
    assert np.diff(at).tolist() == [max(0, len(t.split()) - 1) for t in texts]
    assert pairs[:3].tolist().count(subwords._REPEAT) == 2
    for text, (b, n) in zip(texts, subwords.bags(texts), strict=True):
        alone, times = subwords.bags([text])[0]
        assert (alone == b).all() and (times == n).all()
        assert n.sum() == sum(1 + sum(max(0, len(w) + 3 - g) for g in subwords.GRAMS) for w in text.split()) + max(0, len(text.split()) - 1)


def test_scores_equal_the_unfolded_model():
    """Sums over remembered words equal the mean of the vectors under the softmax, document by document."""
    rng = np.random.default_rng(1)
    vectors, soft = rng.normal(size=(subwords.BUCKETS, 4)), rng.normal(size=(2, 5))
    texts = ["one two two three", "", "four", "two one two one", "ü" * 50]
    apart = soft[1] - soft[0]
    words, sums = subwords.Words(), [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)]
    z = np.concatenate([subwords._logits(part, words, sums, vectors @ apart[:-1]) for part in (texts[:2], texts[2:])]) + apart[-1]
    for got, (b, n) in zip(z, subwords.bags(texts), strict=True):
        mean = np.append(n @ vectors[b] / max(1, n.sum()), 1)
        assert abs(got - (soft @ mean)[1] + (soft @ mean)[0]) < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    out = queries.op13_quality(spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    got = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    right = {q: np.mean([r.predicted == q for r in got if r.quality == q]) for q in (0, 1)}
    assert len(got) > 500 and right[1] >= 0.99 and right[0] >= 0.95


def test_a_small_sample_is_learnt(spark):
    rows = [(i, f"w{i} plain words here" if i % 3 else f"W{i}!! LOUD!! JUNK!! {i}!!") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    got = subwords.score(docs, subwords.fit(docs, labels)).where(subwords.held_out()).collect()
    assert got and all(r.predicted == int(r.doc_id % 3 > 0) for r in got)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x y"), (4, "long " * 100_000), (4, "long " * 100_000), (5, "x" * 300_000)], "doc_id long, text string").withColumns({c: F.lit("old") for c in ("score", "predicted", "label", "_id", "shard", "place", "quality")})
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    rows = subwords.score(docs, subwords.fit(docs, labels)).collect()
    assert len(rows) == 7 and all(r.score < 1e-9 and r.predicted == 0 and r.label == "old" for r in rows)
    labels = spark.createDataFrame([(2, 0), (2, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in subwords.score(docs, subwords.fit(docs, labels)).collect())  # one kind of label only
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    rows = subwords.score(docs, subwords.fit(docs, labels)).collect()
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert all(0 <= r.score <= 1 for r in rows)
    assert subwords.score(docs.limit(0), subwords.fit(docs.limit(0), labels)).collect() == []
    flags = docs.select("doc_id", subwords.held_out().alias("h")).collect()
    assert all(r.h is False for r in flags if r.doc_id is None)
