"""The learned reranker: features, weights and order against plain Python and numpy."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import rerank as L
from tarnwick.plans import q_learn
from tarnwick.plans.registry import QUERIES

DATA = "/root/testdata/sf0.1"


def plain_features(q, w, title, texts):
    """One query and text, word by word."""
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t in q for d in [sum(t in x for x in texts)]}
    if not q:
        return [0.0] * 7
    b = sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in q if t in w)
    at = [(i, x) for i, x in enumerate(w) if x in q]
    gaps = [j - i for i, x in at for j, y in at if i < j and x != y]
    near = sum(any(w[i : i + 2] == [x, y] for i in range(len(w))) for x, y in zip(q, q[1:]))
    out = [b / (1 + b), sum(t in w for t in q) / len(q), sum(idf[t] for t in q if t in w) / sum(idf.values()), 1 / min(gaps) if gaps else 0, near / (len(q) - 1) if len(q) > 1 else 0, sum(t in title for t in q) / len(q), 1 / (1 + at[0][0]) if at else 0]
    return [round(v, 6) for v in out]


def test_features_equal_plain_ones(spark):
    rng = random.Random(2)
    vocabulary = "a b c d e f g h".split()
    texts = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 9, 30]))], rng.sample(vocabulary, 2)) for i in range(60)]
    queries = [(0, ["a", "b", "c"]), (1, ["a"]), (2, []), (3, ["zz", "a"]), (4, ["a", "b", "a", "h"]), (5, ["zz", "yy"])]
    df = spark.createDataFrame(texts, "id int, w array<string>, tw array<string>")
    qs = spark.createDataFrame(queries, "k int, ask array<string>")
    known, stats = L.word_weights(df, "w")
    asked = L.weighted(qs, "k", "ask", known, stats)
    got = {(r.k, r.id): r.x for r in L.features(df.crossJoin(asked)).select("k", "id", "x").collect()}
    assert len(got) == len(texts) * len(queries)
    for k, ask in queries:
        q = list(dict.fromkeys(ask))
        for i, w, tw in texts:
            want = plain_features(q, w, tw, [t[1] for t in texts])
            assert np.allclose(got[k, i], want, atol=2e-6), (q, w)


def newton(d, ridge):
    """The logistic loss on +d and -d, mean over all rows, with a ridge."""
    w = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-d @ w))
        g = d.T @ (p - 1) / len(d) + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def test_weights_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(q, k == 0, [float(v) for v in rng.normal(size=7) + (k == 0) * np.array([1, 0.5, 0, 0, 2, 0, -1])]) for q in range(80) for k in range(6)]
    rows += [(900, False, [0.0] * 7), (901, True, [1.0] * 7)]  # queries without a pair
    got = L.fit(spark.createDataFrame(rows, "query int, relevant boolean, x array<double>"))
    d = np.array([np.subtract(g, x) for q in range(80) for g in [next(x for k, r, x in rows if k == q and r)] for k, r, x in rows if k == q and not r])
    assert np.allclose(got.weights, newton(d, 1e-3), atol=2e-3)
    none = spark.createDataFrame(rows[:0], "query int, relevant boolean, x array<double>")
    assert L.fit(none).weights == (0.0,) * 7


def test_ndcg_and_order(spark):
    rows = [("q", i, i in (1, 4), s) for i, s in enumerate([0.9, 0.5, 0.5, 0.1, 0.7])] + [("none", 1, False, 0.3)]
    ranked = L.reranked(spark.createDataFrame(rows, "query string, id int, relevant boolean, s double"), "query", "id", F.col("s"))
    assert {r.id: r["rank"] for r in ranked.where("query = 'q'").collect()} == {0: 1, 4: 2, 1: 3, 2: 4, 3: 5}
    (row,) = L.ndcg(ranked).collect()
    assert row.ndcg == round((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), 6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_pages_are_ranked_better_than_by_bm25(spark):
    rows = QUERIES["rerank_learned"](spark, DATA).where("held_out")
    learned = L.ndcg(rows, "page_id").agg(F.avg("ndcg")).first()[0]
    plain = L.ndcg(rows.drop("rank").withColumnRenamed("bm25_rank", "rank"), "page_id").agg(F.avg("ndcg")).first()[0]
    assert learned > plain + 0.002 and learned > 0.95
    assert rows.select("page_id").distinct().where(~q_learn.held_out(F.col("page_id"))).count() == 0


def test_a_question_is_an_argument(spark):
    docs = spark.createDataFrame([(1, "red fox runs", "fox"), (2, "a red blue fox", None), (3, "nothing", ""), (4, None, None)], "id int, text string, title string")
    for question, best in (("red fox", 1), ("blue fox", 2), ("nothing?", 3)):
        top = L.ask(docs, question, "text", "title").orderBy(F.desc("score"), "id").first()
        assert top.id == best
    assert L.ask(docs, "  ", "text", "title").count() == 4
