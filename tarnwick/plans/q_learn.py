"""Queries of the learned reranker: features, a ranker trained on the spot, the stored one, and a question over documents.

Each page asks for one of its own sentences: the one of least hash among those of seven words or more, by its second,
third, fifth and seventh word. The page's sentences are what is ranked, that one is relevant."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import rerank as L
from tarnwick.plans import q_rank as Q
from tarnwick.plans.base import query, table
from tarnwick.session import checkpointed

_FEATURES = f"""{Q.PAGES}, se AS (SELECT page_id, coalesce({Q.WORDS.format("title")}, []) AS tw, unnest(range(0, len(l)))::INT AS chunk_id, unnest(l) AS chunk FROM (SELECT *, {Q._SENTENCES} AS l FROM pg)),
sw AS (SELECT *, {Q.WORDS.format("chunk")} AS w FROM se),
fo AS (SELECT page_id, chunk_id AS wanted, [w[2], w[3], w[5], w[7]] AS ask FROM sw WHERE len(w) >= 7 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY md5(page_id || '-' || chunk_id)) = 1),
kn AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM sw) GROUP BY word), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM sw),
oq AS (SELECT page_id, wanted, unnest(range(1, 5)) AS i, unnest(ask) AS word, ask FROM fo), aq AS (SELECT page_id, any_value(wanted) AS wanted, any_value(mean) AS mean, list(word ORDER BY i) AS q, list(ln(1 + (n - df + 0.5) / (df + 0.5)) ORDER BY i) AS idf FROM oq JOIN kn USING (word), st WHERE list_position(ask, word) = i GROUP BY page_id),
pr AS (SELECT sw.*, wanted, mean, q, idf, list_transform(q, lambda t: len(list_filter(w, lambda x: x = t))::DOUBLE) AS tf,
 list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i - 1, 'w': w[i]}}), lambda h: list_contains(q, h.w)) AS hit, ' ' || array_to_string(w, ' ') || ' ' AS line FROM sw JOIN aq USING (page_id)),
ft AS (SELECT page_id, chunk_id, chunk_id = wanted AS relevant,
 list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN tf[i] > 0 THEN idf[i] * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(w) / mean)) ELSE 0.0::DOUBLE END)) AS b, len(list_filter(tf, lambda t: t > 0)) / len(q) AS words,
 list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN tf[i] > 0 THEN idf[i] ELSE 0.0::DOUBLE END)) / list_sum(idf) AS weights,
 1.0::DOUBLE / list_min(list_transform(range(2, len(hit) + 1), lambda k: CASE WHEN hit[k].w <> hit[k - 1].w THEN hit[k].i - hit[k - 1].i END)) AS closeness,
 CASE WHEN len(q) > 1 THEN len(list_filter(range(2, len(q) + 1), lambda k: contains(line, ' ' || q[k - 1] || ' ' || q[k] || ' '))) / (len(q) - 1) END AS phrase,
 len(list_filter(q, lambda t: list_contains(tw, t))) / len(q) AS title, 1.0::DOUBLE / (1 + hit[1].i) AS early FROM pr),
fx AS (SELECT page_id, chunk_id, relevant, round(b / (1 + b), 6) AS bm25, round(words, 6) AS words, round(weights, 6) AS weights, round(coalesce(closeness, 0), 6) AS closeness, round(coalesce(phrase, 0), 6) AS phrase, round(title, 6) AS title, round(coalesce(early, 0), 6) AS early FROM ft)"""


def asked_sentences(spark, sf):
    """(page_id, chunk_id, relevant, x): the sentences of each page, told for the page's own question."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce(T.words(T.html_title(F.col("html"))), F.array().cast("array<string>")).alias("tw"), T.strip_tags(F.col("html")).alias("body"))
    chunks = p.select("page_id", "tw", F.posexplode(T.blocks(F.col("body"), r"\. ")).alias("chunk_id", "chunk"))
    chunks = checkpointed(chunks.select("page_id", "tw", "chunk_id", T.words(F.col("chunk")).alias("w")))
    known, stats = L.word_weights(chunks, "w")
    by_hash = F.struct(F.md5(F.concat_ws("-", F.col("page_id").cast("string"), F.col("chunk_id").cast("string"))).alias("h"), F.col("chunk_id").alias("wanted"), F.array(*[F.get("w", F.lit(i)) for i in (1, 2, 4, 6)]).alias("ask"))
    wanted = chunks.where(F.size("w") >= 7).groupBy("page_id").agg(F.min(by_hash).alias("f")).select("page_id", "f.wanted", "f.ask")
    asked = L.weighted(wanted, "page_id", "ask", known, stats)
    pairs = chunks.join(asked, "page_id").withColumn("relevant", F.col("chunk_id") == F.col("wanted"))
    return L.features(pairs).select("page_id", "chunk_id", "relevant", "x")


@query(f"WITH {_FEATURES} SELECT * FROM fx")
def rerank_features(spark, sf):
    x = asked_sentences(spark, sf)
    return x.select("page_id", "chunk_id", "relevant", *[F.col("x")[k].alias(n) for k, n in enumerate(L.FEATURES)])


@query(f"WITH {_FEATURES}, sc AS (SELECT page_id, chunk_id, relevant, round(1 / (1 + exp(-(bm25 * {{0}}))), 6) AS score FROM fx) SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc".replace("bm25 * {0}", " + ".join(f"{n} * {w}" for n, w in zip("bm25 words weights closeness phrase title early".split(), L.DEFAULT.weights, strict=True))))
def rerank_stored(spark, sf):
    """Each page's sentences in the order of the stored ranker."""
    return L.reranked(asked_sentences(spark, sf), "page_id", "chunk_id", L.DEFAULT.score()).drop("x")


def held_out(page):
    return F.crc32(page.cast("string").cast("binary")) % 5 == 0


@query()
def rerank_learned(spark, sf):
    """A ranker learnt from four fifths of the pages; all sentences with its score and rank, and BM25's rank beside it."""
    x = checkpointed(asked_sentences(spark, sf).withColumn("held_out", held_out(F.col("page_id"))))
    ranker = L.fit(x.where("not held_out"), "page_id")
    plain = L.reranked(x, "page_id", "chunk_id", F.col("x")[0]).withColumnRenamed("rank", "bm25_rank")
    return L.reranked(plain, "page_id", "chunk_id", ranker.score()).drop("x")


QUESTION = "the order of things and the rend"


@query(
    f"""WITH dw AS (SELECT doc_id, {Q.WORDS.format("text")} AS w FROM documents), qw AS (SELECT ['the', 'order', 'of', 'things', 'and', 'rend'] AS q), kn AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM dw) GROUP BY word), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
aq AS (SELECT any_value(mean) AS mean, any_value(q) AS q, list(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) ORDER BY i) AS idf FROM (SELECT q, unnest(q) AS word, unnest(range(1, 7)) AS i FROM qw) LEFT JOIN kn USING (word), st),
pr AS (SELECT doc_id, w, mean, q, idf, list_transform(q, lambda t: len(list_filter(w, lambda x: x = t))::DOUBLE) AS tf, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i - 1, 'w': w[i]}}), lambda h: list_contains(q, h.w)) AS hit, ' ' || array_to_string(w, ' ') || ' ' AS line FROM dw, aq),
ft AS (SELECT doc_id, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN tf[i] > 0 THEN idf[i] * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(w) / mean)) ELSE 0.0::DOUBLE END)) AS b, len(list_filter(tf, lambda t: t > 0)) / 6 AS words,
 list_sum(list_transform(range(1, 7), lambda i: CASE WHEN tf[i] > 0 THEN idf[i] ELSE 0.0::DOUBLE END)) / list_sum(idf) AS weights, 1.0::DOUBLE / list_min(list_transform(range(2, len(hit) + 1), lambda k: CASE WHEN hit[k].w <> hit[k - 1].w THEN hit[k].i - hit[k - 1].i END)) AS closeness,
 len(list_filter(range(2, 7), lambda k: contains(line, ' ' || q[k - 1] || ' ' || q[k] || ' '))) / 5 AS phrase, 1.0::DOUBLE / (1 + hit[1].i) AS early FROM pr)
SELECT doc_id, round(1 / (1 + exp(-({" + ".join(f"round({n}, 6) * {w}" for n, w in zip(("b / (1 + b)", "words", "weights", "coalesce(closeness, 0)", "phrase", "0", "coalesce(early, 0)"), L.DEFAULT.weights, strict=True))}))), 6) AS score FROM ft ORDER BY score DESC, doc_id LIMIT 10"""
)
def rerank_question(spark, sf, question: str = QUESTION):
    """The ten documents that the stored ranker puts first for a question."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit("").alias("title"))
    return L.ask(d, question, "text", "title").select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(10)
