"""A learned reranker: features of a query and a text, a pairwise linear ranker, scores and their NDCG.

Features are expressions in the JVM over the words of both; the corpus gives a table of how many texts hold a word. The ranker
is a logistic regression (``pyspark.ml``) on differences of a query's relevant and other texts, so it learns order
and no base rate; its weights are a few numbers that go into the scoring expression. Each query has its own words: they are data, not code.

Defined cases: a null or blank text has no words and zeros for all features but ``title``; a query without
words has zeros and keeps its rows; words that no text holds have the largest weight; repeated query words count once, at
their first place. Queries without relevant or without other texts teach nothing; without any pair all weights are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T

K1, B = 1.2, 0.75
#: What is told of a query and a text, each from 0 to 1: BM25 squashed, share of the words, of their weights, closeness of
#: two different words, share of neighbours that are neighbours, share of the words in the title, nearness of the first to the beginning.
FEATURES = ("bm25", "words", "weights", "closeness", "phrase", "title", "early")


def word_weights(texts: DataFrame, words: str) -> tuple[DataFrame, DataFrame]:
    """(word, df) of all texts, and one row of their number and mean length."""
    known = texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return known, texts.agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("mean"))


def weighted(queries: DataFrame, key: str, words: str, known: DataFrame, stats: DataFrame) -> DataFrame:
    """``queries`` with q, their distinct words in order, and idf, the words' weights, and the mean length of a text."""
    each = queries.select(key, F.posexplode_outer(F.array_distinct(words)).alias("i", "word")).join(known, "word", "left").join(F.broadcast(stats))  # one row
    df = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    got = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "word", idf.alias("idf"))))).alias("s"), F.first("mean").alias("mean"))
    return queries.join(got.select(key, F.transform("s", lambda x: x["word"]).alias("q"), F.transform("s", lambda x: x["idf"]).alias("idf"), "mean"), key)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def features(pairs: DataFrame, text_words: str = "w", title_words: str = "tw") -> DataFrame:
    """``pairs`` (q, idf, mean of the query; words of text and title) with x, the array of FEATURES."""
    w, q = F.col(text_words), F.col("q")
    pairs = pairs.withColumn("_tf", F.transform(q, lambda t: F.size(F.filter(w, lambda x: x == t)).cast("double")))
    pairs = pairs.withColumn("_hit", F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda h: F.array_contains(q, h["w"])))
    length = K1 * (1 - B + B * F.size(w) / F.col("mean"))
    bm = _sum(F.zip_with("idf", "_tf", lambda i, t: F.when(t > 0, i * t * (K1 + 1) / (t + length)).otherwise(0.0)))
    n = F.size(q)
    there = F.size(F.filter("_tf", lambda t: t > 0)) / n
    mass = _sum(F.zip_with("idf", "_tf", lambda i, t: F.when(t > 0, i).otherwise(0.0))) / _sum(F.col("idf"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("_hit")), lambda k: F.when(F.element_at("_hit", k)["w"] != F.element_at("_hit", k - 1)["w"], F.element_at("_hit", k)["i"] - F.element_at("_hit", k - 1)["i"]))
    close = F.when(F.size("_hit") > 1, 1 / F.array_min(gaps))
    line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    told = F.transform(F.sequence(F.lit(2), n), lambda k: F.contains(line, F.concat(F.lit(" "), F.element_at(q, k - 1), F.lit(" "), F.element_at(q, k), F.lit(" "))))
    phrase = F.when(n > 1, F.size(F.filter(told, lambda x: x)) / (n - 1))
    title = F.size(F.array_intersect(q, F.coalesce(F.col(title_words), F.array().cast("array<string>")))) / n
    early = F.when(F.size("_hit") > 0, 1 / (1 + F.element_at("_hit", 1)["i"]))
    known = F.when(n > 0, F.lit(True))
    x = [bm / (1 + bm), there, mass, close, phrase, title, early]
    return pairs.withColumn("x", F.array(*[F.round(F.coalesce(F.when(known, v), F.lit(0.0)), 6) for v in x])).drop("_tf", "_hit")


@dataclass(frozen=True)
class Ranker:
    """Weights of FEATURES, learnt by ``fit``."""

    weights: tuple[float, ...]

    def score(self, x: str = "x") -> Column:
        """From 0 to 1; the order of a query's texts is all that it means."""
        total = sum((F.col(x)[k] * w for k, w in enumerate(self.weights)), F.lit(0.0))
        return F.round(1 / (1 + F.exp(-total)), 6)


#: A ranker that ``fit`` has learnt from the pages of sf0.1, for use without training.
DEFAULT = Ranker((1.014318, 1.755962, 2.003386, 1.686835, 0.800722, 0.0, 0.651476))


def differences(known: DataFrame, query: str, relevant: str) -> DataFrame:
    """(label, features): of each query, relevant minus other texts, and the reverse.

    Made from a query's relevant ones (few) joined to its others, each difference once; no group is gathered."""
    good = known.where(relevant).select(query, F.col("x").alias("g"))
    pairs = known.where(~F.col(relevant)).select(query, "x").join(good, query).select(F.zip_with("g", "x", lambda a, b: a - b).alias("d"))
    back = pairs.select(F.transform("d", lambda v: -v).alias("d"), F.lit(0.0).alias("label"))
    return pairs.select("d", F.lit(1.0).alias("label")).unionByName(back).select("label", array_to_vector("d").alias("features"))


def fit(known: DataFrame, query: str = "query", relevant: str = "relevant", ridge: float = 1e-3) -> Ranker:
    """A ranker from rows (query, relevant, x): weights of the logistic loss over all pairs, with a ridge."""
    pairs = differences(known, query, relevant)
    if not pairs.head(1):
        return Ranker((0.0,) * len(FEATURES))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=ridge, maxIter=200, tol=1e-9).fit(pairs)
    return Ranker(tuple(round(float(v), 6) for v in model.coefficients))


def reranked(df: DataFrame, query: str, key: str, score: Column) -> DataFrame:
    """``df`` with score and rank, best first, ties by key."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)  # one query's texts
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def ndcg(ranked: DataFrame, query: str = "query", relevant: str = "relevant", most: int = 10) -> DataFrame:
    """(query, ndcg): the gain of relevant texts among the first ``most``, as a share of the best order's."""
    gain = F.when(F.col(relevant) & (F.col("rank") <= most), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    each = ranked.groupBy(query).agg(F.sum(gain).alias("g"), F.count_if(relevant).alias("n")).where("n > 0")
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(most)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return each.select(query, F.round(F.col("g") / best, 6).alias("ndcg"))


def ask(texts: DataFrame, question: str, text: str, title: str, ranker: Ranker = DEFAULT) -> DataFrame:
    """``texts`` with their score for a question in words."""
    spark = texts.sparkSession
    rows = texts.withColumns({"_w": T.words(F.col(text)), "_tw": T.words(F.col(title))})
    known, stats = word_weights(rows, "_w")
    one = spark.createDataFrame([(0, question)], "_k int, question string").select("_k", T.words(F.col("question")).alias("_qw"))
    asked = weighted(one, "_k", "_qw", known, stats).select("q", "idf", "mean")
    scored = features(rows.join(F.broadcast(asked)), "_w", "_tw")  # one row
    return scored.withColumn("score", ranker.score()).drop("_w", "_tw", "q", "idf", "mean", "x")
