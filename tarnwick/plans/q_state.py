"""Queries of limits, unions, counters, keyed state, graphs, evaluation and rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.operators import dedup as D
from tarnwick.operators import graph as G
from tarnwick.operators import rank as R
from tarnwick.operators import state as K
from tarnwick.plans import q_rank as Q
from tarnwick.plans import q_scalar as S
from tarnwick.plans.base import query, table
from tarnwick.session import checkpointed


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10")
def limit_results(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(10)


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) <= 5 AS scrape FROM (SELECT * FROM pages ORDER BY page_id LIMIT 10)")
def scrape_budget(spark, sf):
    """The first rows of a result take the expensive branch."""
    p = limit_results(spark, sf)
    return R.final_rank(p, F.col("page_id"), name="k").select("page_id", (F.col("k") <= 5).alias("scrape"))


@query(
    f"""WITH p AS (SELECT page_id, {S.HOST} AS h FROM pages), one AS (SELECT * FROM (SELECT * FROM p ORDER BY page_id LIMIT 10) WHERE ends_with(h, 'example.org')),
two AS (SELECT * FROM (SELECT * FROM p ORDER BY page_id LIMIT 10 OFFSET 10) WHERE ends_with(h, 'example.org') AND (SELECT count(*) FROM one) BETWEEN 1 AND 9) SELECT page_id, h FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY page_id LIMIT 10"""
)
def page2_union(spark, sf):
    """The second page of results joins only if the first gave some rows, but too few."""
    p = table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("h"))
    one = p.orderBy("page_id").limit(10).where(F.endswith("h", F.lit("example.org")))
    gate = one.agg(F.count("*").alias("n")).where("n between 1 and 9")  # one row or none
    second = R.final_rank(p.orderBy("page_id").limit(20), F.col("page_id")).where("rank > 10").drop("rank")
    two = second.where(F.endswith("h", F.lit("example.org"))).crossJoin(F.broadcast(gate)).drop("n")
    return one.unionByName(two).orderBy("page_id").limit(10)




@query(
    "WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS engine, CASE event_id % 4 WHEN 1 THEN 'blocked' WHEN 3 THEN NULL ELSE 'timeout' END AS reason FROM events)"
    " SELECT engine, reason, min(event_id) AS first_seen FROM w WHERE engine IS NOT NULL GROUP BY engine, reason"
)
def engine_warnings(spark, sf):
    """Distinct (engine, reason) of entries that are lists, objects of two spellings, or junk."""
    k = F.col("event_id") % 4
    e = F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit('["'), e, F.lit('","timeout"]'))).when(k == 1, F.concat(F.lit('{"engine":"'), e, F.lit('","reason":"blocked"}'))).when(k == 2, F.concat(F.lit('{"name":"'), e, F.lit('","error":"timeout"}'))).otherwise("42")
    v = table(spark, sf, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    get = lambda *paths: F.coalesce(*[F.try_variant_get("v", p, "string") for p in paths])
    w = v.select("event_id", get("$[0]", "$.name", "$.engine").alias("engine"), get("$[1]", "$.error", "$.reason").alias("reason"))
    return w.where("engine is not null and engine <> ''").groupBy("engine", "reason").agg(F.min("event_id").alias("first_seen"))


@query("SELECT greatest(count(DISTINCT normalized), 1)::BIGINT AS visited FROM (" + S.QUERY_NORMALIZE + ")")
def pages_visited(spark, sf):
    return S.url_normalize(spark, sf).agg(F.greatest(F.count_distinct("normalized"), F.lit(1)).alias("visited"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*)::BIGINT AS total FROM events GROUP BY user_id")
def status_counts(spark, sf):
    bad = F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.count("*").alias("total"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE length(text) END::BIGINT AS total_chars, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'sha256:' || sha256(text) END AS content_hash FROM documents")
def page_envelope(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content"))
    return d.select("doc_id", F.when(F.nullif("content", F.lit("")).isNull(), "error").otherwise("ok").alias("status"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("total_chars"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def time_range_filter(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.crossJoin(F.broadcast(now)).where("ts >= now - interval 7 days").select("event_id")


# keyed state


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < 3600000000, false) AS seen FROM events")
def seen_within_ttl(spark, sf):
    return K.seen_within(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "seen")


@query(
    "SELECT e.event_id, s.stored, coalesce(epoch_us(e.ts) - epoch_us(s.ts) < 3600000000, false) AS seen FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS stored FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id, ts) s ON e.user_id = s.user_id AND e.ts >= s.ts"
)
def asof_seen(spark, sf):
    """Each event with the last entry that its user's store held by then, and whether that was still alive."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    store = e.where(F.col("event_type").isin("signup", "purchase")).select("user_id", "ts", F.col("event_id").alias("stored"))
    got = K.as_of(e, store, ["user_id"], "stored")
    return got.select("event_id", "stored", F.coalesce(K.seconds("ts") - K.seconds("stored_ts") < K.TTL, F.lit(False)).alias("seen"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 60 ELSE 3600 END::INT AS ttl FROM events")
def failure_ttl(spark, sf):
    return table(spark, sf, "events").select("event_id", K.failure_ttl(F.when(F.col("event_type") == "error", "error").otherwise("ok")).alias("ttl"))


_REPLAY = """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'error' THEN 60 ELSE 3600 END) AS k, epoch_us(ts)::DOUBLE / 1000000 AS t, CASE WHEN event_type = 'error' THEN 60 ELSE 3600 END AS ttl FROM events),
r AS (SELECT user_id, k, t + ttl AS until, false AS hit FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN o.t < r.until THEN r.until ELSE o.t + o.ttl END, o.t < r.until FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) """


def _replay(spark, sf):
    ttl = F.when(F.col("event_type") == "error", 60).otherwise(3600)
    return K.replay(table(spark, sf, "events"), ["user_id"], ttl)


@query(_REPLAY + "SELECT user_id, count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses FROM r GROUP BY user_id")
def cache_replay(spark, sf):
    """Which accesses of a read-through cache hit: hits don't refresh, failures live shorter."""
    return _replay(spark, sf)


@query(_REPLAY + "SELECT count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses FROM r")
def cache_stats(spark, sf):
    return _replay(spark, sf).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


# graphs


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), g AS (SELECT 'o' || o AS src, 'p' || p AS dst FROM e UNION SELECT 'p' || p, 'o' || o FROM e),
b AS (SELECT 'o1' AS node, 0 AS depth UNION SELECT g.dst, b.depth + 1 FROM b JOIN g ON g.src = b.node WHERE b.depth < 4) SELECT node, min(depth)::INT AS depth FROM b GROUP BY node"""
)
def bfs_depth(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("o"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p")).distinct()
    edges = e.select(F.col("o").alias("src"), F.col("p").alias("dst")).union(e.select(F.col("p").alias("src"), F.col("o").alias("dst")))
    return G.bfs(edges, spark.createDataFrame([("o1",)], "node string"), 4).select("node", "depth")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS n, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey), g AS (SELECT 'n' || n AS src, 's' || s AS dst FROM e UNION SELECT 's' || s, 'r' || n_regionkey FROM e JOIN nation ON n = n_nationkey UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
b AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT g.dst, b.depth + 1 FROM b JOIN g ON g.src = b.node WHERE b.depth < 3), d AS (SELECT node, min(depth) AS depth FROM b GROUP BY node)
SELECT d.node, d.depth::INT AS depth, min(p.node) AS parent FROM d LEFT JOIN (SELECT g.dst, d.node, d.depth FROM g JOIN d ON d.node = g.src) p ON p.dst = d.node AND p.depth = d.depth - 1 GROUP BY d.node, d.depth"""
)
def bfs_parent(spark, sf):
    """Nodes with the least of the parents that reach them first."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, sf, "nation")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    e = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")).join(c, "k").join(nation.select(F.col("n_nationkey").alias("k"), "n_regionkey"), "k")
    edges = e.select(name("n", "k").alias("src"), name("s", "s_suppkey").alias("dst")).union(e.select(name("s", "s_suppkey"), name("r", "n_regionkey"))).union(nation.select(name("r", "n_regionkey"), name("n", "n_nationkey"))).distinct()
    return G.bfs(edges, spark.createDataFrame([("r1",)], "node string"), 3).select("node", "depth", "parent")


_TREE = f"WITH {S.LINKS}, t AS (SELECT page_id, url, target, min(pos) AS pos, arg_min(label, pos) AS label FROM r WHERE regexp_matches(target, '^https?://[^/?#]+') GROUP BY page_id, url, target), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) + 1 AS rank FROM t)"


def _tree(spark, sf):
    p = table(spark, sf, "pages")
    e = S.page_edges(p).withColumn("target", U.resolve(F.col("url"), F.col("href"))).where("target is not null")
    first = D.first_of(e, F.struct("page_id", "target"), "pos")
    k = first.withColumn("rank", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) + 1).cast("int")).where("rank <= 6")
    root = p.select("page_id", F.col("url").alias("target"), F.lit(1).alias("rank"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from"), F.lit("seed").alias("link_type"), F.lit(None).cast("string").alias("label"))
    kids = k.select("page_id", "target", "rank", F.lit(1).alias("depth"), F.col("url").alias("discovered_from"), F.lit("internal").alias("link_type"), U.link_label(F.col("label")).alias("label"))
    return root.unionByName(kids)


@query(_TREE + " SELECT page_id, url AS target, 1 AS rank, 0 AS depth, NULL::VARCHAR AS discovered_from, 'seed' AS link_type FROM pages UNION ALL SELECT page_id, target, rank::INT, 1, url, 'internal' FROM k WHERE rank <= 6")
def map_tree(spark, sf):
    """The bounded link tree of each seed page: root first, then links in page order."""
    return _tree(spark, sf).drop("label")


@query(f"WITH {S.LINKS} SELECT target, min(page_id) AS first_page FROM r WHERE regexp_matches(target, '^https?://[^/?#]+') GROUP BY target")
def map_dedup(spark, sf):
    e = S.page_edges(table(spark, sf, "pages")).withColumn("target", U.resolve(F.col("url"), F.col("href"))).where("target is not null")
    return e.groupBy("target").agg(F.min("page_id").alias("first_page"))


_CRAWL = f"WITH {Q.PAGES}, {Q.bm25_cte('pg', 'page_id', 'content')}, j AS (SELECT pg.page_id, CASE WHEN {Q.SCRAPED} THEN score END AS score, content FROM pg JOIN bm USING (page_id))"


@query(_CRAWL + ", k AS (SELECT page_id, score, row_number() OVER (ORDER BY score IS NULL, score DESC, page_id)::INT AS rank FROM j) SELECT * FROM k")
def crawl_rank(spark, sf):
    """Pages with scores first, best first, then the others in order."""
    s = Q.pages_scored(spark, sf).select("page_id", F.when(Q.scraped(F.col("content")), F.col("score")).alias("score"))
    order = (F.col("score").isNull(), F.desc("score"), F.col("page_id"))
    return R.ranked(s, *order)


def trees_sql(depth: int) -> str:
    """CTEs that end in tr: the search of each seed level by level, over ed (page, pos, target, key, scope), th (key, page) and sd (seed, page, target, key, scope, budget)."""
    out = "v0 AS (SELECT seed, key, target, 0 AS depth, 1::BIGINT AS rank, NULL::VARCHAR AS parent, page, scope, budget FROM sd WHERE budget >= 1)"
    for d in range(1, depth + 1):
        out += f""",
c{d} AS (SELECT v.seed, e.key, any_value(v.scope) AS scope, any_value(v.budget) AS budget, min(v.rank) AS r, arg_min(e.pos, (v.rank, e.pos)) AS pos, arg_min(e.target, (v.rank, e.pos)) AS target, arg_min(v.target, (v.rank, e.pos)) AS parent
 FROM v{d - 1} v JOIN ed e ON e.page = v.page WHERE v.depth = {d - 1} AND (v.scope IS NULL OR v.scope = e.scope) GROUP BY v.seed, e.key),
n{d} AS (SELECT c.*, row_number() OVER (PARTITION BY seed ORDER BY r, pos, key) + (SELECT max(rank) FROM v{d - 1} m WHERE m.seed = c.seed) AS k FROM c{d} c WHERE NOT EXISTS (SELECT 1 FROM v{d - 1} m WHERE m.seed = c.seed AND m.key = c.key)),
v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT seed, n.key, n.target, {d}, k, parent, th.page, n.scope, budget FROM n{d} n LEFT JOIN th ON th.key = n.key WHERE k <= budget)"""
    return out + f", tr AS (SELECT seed, key, target, depth::INT AS depth, rank::INT AS rank, parent FROM v{depth})"


_LINKED = f"""{S.LINKS}, nn AS (SELECT page_id, normalized FROM ({S.QUERY_NORMALIZE})),
tn AS (SELECT DISTINCT target FROM r WHERE regexp_matches(target, '^https?://[^/?#]+')), pages2 AS (SELECT row_number() OVER (ORDER BY target) AS page_id, target AS url FROM tn),
t2 AS (SELECT url AS target, normalized AS tn FROM ({S.QUERY_NORMALIZE.replace("FROM pages)", "FROM pages2)", 1)}) x JOIN pages2 USING (page_id)),
hs AS (SELECT target, {S.HOST.replace("url", "target")} AS h FROM t2 UNION SELECT url, {S.HOST} FROM pages), dom AS (SELECT target, {S.REG} AS d FROM hs),
ed AS (SELECT r.page_id AS page, r.pos, r.target, t2.tn AS key, dom.d AS scope FROM r JOIN t2 USING (target) JOIN dom USING (target)),
th AS (SELECT normalized AS key, min(page_id) AS page FROM nn WHERE page_id IN (SELECT page FROM ed) GROUP BY normalized)"""
_SEEDS = "sd AS (SELECT page_id AS seed, page_id AS page, url AS target, normalized AS key, dom.d AS scope, {0} AS budget FROM pages JOIN nn USING (page_id) JOIN dom ON dom.target = pages.url)"
_SITE = f"{_LINKED}, {_SEEDS.format(6)}, {trees_sql(2)}"


def site_tree(spark, sf, depth: int = 2, budget=6):
    """(seed, key, target, depth, rank, parent): breadth-first link trees from every page, held to the seed's
    registrable domain, one row for each normalised url, ``budget`` rows with the root."""
    p = table(spark, sf, "pages")
    links = S.page_edges(p).withColumn("target", U.resolve(F.col("url"), F.col("href"))).where("target is not null")
    reg = lambda c: U.registrable_domain(U.domain(F.col(c)))
    edges = checkpointed(links.select(F.col("page_id").alias("page"), "pos", "target", U.normalize(F.col("target")).alias("key"), reg("target").alias("scope")))
    roots = checkpointed(p.select(F.col("page_id").alias("seed"), F.col("page_id").alias("page"), F.col("url").alias("target"), U.normalize(F.col("url")).alias("key"), reg("url").alias("scope")))
    # a found url is followed where its page is there: of pages with one spelling the first with links
    there = roots.join(edges.select("page").distinct(), "page", "left_semi").groupBy("key").agg(F.min("page").alias("page"))
    return G.trees(edges, there, roots.withColumn("budget", F.lit(budget) if isinstance(budget, int) else budget), depth)


@query(f"WITH {_SITE} SELECT seed, target, rank, depth, parent AS discovered_from FROM tr")
def site_map(spark, sf):
    return site_tree(spark, sf).select("seed", "target", "rank", "depth", F.col("parent").alias("discovered_from"))


@query(f"WITH {_LINKED}, {_SEEDS.format('1 + page_id % 50')}, {trees_sql(4)} SELECT seed, target, rank, depth, parent AS discovered_from FROM tr")
def site_map_deep(spark, sf):
    """Link trees of up to four steps, each seed with a budget of its own, from 1 to 50."""
    deep = site_tree(spark, sf, 4, 1 + F.col("seed") % 50)
    return deep.select("seed", "target", "rank", "depth", F.col("parent").alias("discovered_from"))


@query(
    "WITH ed AS (SELECT 'n' || c_nationkey AS page, c_custkey AS pos, 'c' || c_custkey AS target, target AS key, c_mktsegment AS scope FROM customer UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'o' || o_orderkey, 'o' || o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"
    " UNION ALL SELECT 'o' || l_orderkey, l_linenumber, 'p' || l_partkey, 'p' || l_partkey, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),"
    " th AS (SELECT DISTINCT page AS key, page FROM ed), sd AS (SELECT DISTINCT c_nationkey || c_mktsegment AS seed, 'n' || c_nationkey AS page, 'n' || c_nationkey AS target, target AS key, c_mktsegment AS scope, 1 + 7 * c_nationkey AS budget FROM customer),"
    + trees_sql(3)
    + " SELECT seed, target, rank, depth, parent FROM tr"
)
def bfs_budget(spark, sf):
    """Customers, orders and parts reached from each nation within one market segment, with budgets from 1 to 169."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("scope"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edge = lambda df, src, pos, dst: df.select(src.alias("page"), F.col(pos).cast("long").alias("pos"), dst.alias("target"), dst.alias("key"), "scope")
    edges = edge(customer, name("n", "c_nationkey"), "c_custkey", name("c", "c_custkey")).unionByName(edge(orders, name("c", "o_custkey"), "o_orderkey", name("o", "o_orderkey"))).unionByName(edge(lines, name("o", "l_orderkey"), "l_linenumber", name("p", "l_partkey")))
    node = name("n", "c_nationkey")
    seeds = customer.select("c_nationkey", "scope").distinct()
    seeds = seeds.select(F.concat(F.col("c_nationkey").cast("string"), "scope").alias("seed"), node.alias("page"), node.alias("target"), node.alias("key"), "scope", (1 + 7 * F.col("c_nationkey")).alias("budget"))
    return G.trees(edges, edges.select(F.col("page").alias("key"), "page").distinct(), seeds, 3).select("seed", "target", "rank", "depth", "parent")


@query(
    f"WITH {Q.PAGES}, {Q.bm25_cte('pg', 'page_id, content', 'content')}, {_SITE}, ex AS (SELECT nn.normalized AS n, min(page_id) AS page_id FROM nn GROUP BY nn.normalized), dc AS (SELECT ex.n, score, content FROM ex JOIN bm USING (page_id) WHERE {Q.SCRAPED}),"
    " j AS (SELECT seed, target, depth, tr.rank AS found, score, content FROM tr LEFT JOIN dc ON dc.n = tr.key) SELECT seed, target, depth, score, CASE WHEN content IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(length(content), 0)::INT AS total_chars, row_number() OVER (PARTITION BY seed ORDER BY score IS NULL, score DESC, found)::INT AS rank FROM j"
)
def crawl_pipeline(spark, sf):
    """Each seed's tree, its urls joined with what was extracted from them, the relevant ones first."""
    tree = site_tree(spark, sf).withColumnsRenamed({"rank": "found", "key": "n"})
    pages = Q.pages_scored(spark, sf).withColumn("n", U.normalize(F.col("url")))
    docs = D.first_of(pages, F.col("n"), "page_id").where(Q.scraped(F.col("content"))).select("n", "score", F.length("content").alias("total_chars"))
    j = tree.join(docs, "n", "left").select("seed", "target", "depth", "found", "score", F.when(F.col("total_chars").isNull(), "error").otherwise("ok").alias("status"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"))
    return R.top_k(j, "seed", 6, F.col("score").isNull(), F.desc("score"), F.col("found")).drop("found")


# evaluation: documents of a source are the results of a query, their language is the domain

_RES = """WITH j AS (SELECT DISTINCT source AS id, CASE WHEN source LIKE '%5' THEN [] ELSE ['en', 'de'] END AS expected, source LIKE '%3' AS fresh, CASE WHEN source LIKE '%7' THEN NULL ELSE 2 END::INT AS target FROM documents),
q AS (SELECT source AS id, lang AS domain, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, n_chars, n_chars >= 1000 AS scraped FROM documents), f AS (SELECT q.*, expected, list_contains(expected, domain) AS hit FROM q JOIN j USING (id) WHERE rank <= 5)"""


def _judgments(spark, sf):
    """(id, expected, fresh, target): what is known of each query."""
    s = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    none = F.array().cast("array<string>")
    return s.select("id", F.when(F.endswith("id", F.lit("5")), none).otherwise(F.array(F.lit("en"), F.lit("de"))).alias("expected"), F.endswith("id", F.lit("3")).alias("fresh"), F.when(~F.endswith("id", F.lit("7")), 2).alias("target"))


def _results(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("id"), F.col("lang").alias("domain"), "n_chars", (F.col("n_chars") >= 1000).alias("scraped"))
    top = R.top_k(d, "id", 5, F.desc("n_chars"), F.col("doc_id")).join(_judgments(spark, sf).select("id", "expected"), "id")
    return top.withColumn("hit", F.exists("expected", lambda e: (F.col("domain") == e) | F.endswith(F.col("domain"), F.concat(F.lit("."), e))))


def _concentration(rows, n):
    per = rows.where((F.col("rank") <= n) & (F.col("domain") != "")).groupBy("id", "domain").agg(F.count("*").alias("c"))
    return per.groupBy("id").agg(F.max("c").alias(f"concentration_{n}"))


@query(_RES + ", c AS (SELECT id, domain, count(*) AS c FROM f WHERE domain <> '' GROUP BY id, domain) SELECT id, max(c)::BIGINT AS concentration_5 FROM c GROUP BY id")
def domain_concentration(spark, sf):
    return _concentration(_results(spark, sf), 5)


@query(_RES + " SELECT id, count(*) FILTER (rank <= 3 AND hit)::BIGINT AS hits_3, count(*) FILTER (hit)::BIGINT AS hits_5 FROM f GROUP BY id")
def eval_domain_hits(spark, sf):
    return _results(spark, sf).groupBy("id").agg(F.count_if(F.col("hit") & (F.col("rank") <= 3)).alias("hits_3"), F.count_if("hit").alias("hits_5"))


_USE = "CASE WHEN count(*) FILTER (rank <= {0}) = 0 THEN 0 WHEN len(any_value(expected)) > 0 THEN least(count(*) FILTER (rank <= {0} AND hit), 2) WHEN count(*) FILTER (rank <= {0} AND scraped) >= least(2, {0}) THEN 2 ELSE least(count(*) FILTER (rank <= {0} AND scraped), 1) END::INT"


def _useful(n):
    """0 to 2: by expected domains where some are named, else by scraped results with content."""
    top = F.col("rank") <= n
    hits, got = F.count_if(top & F.col("hit")), F.count_if(top & F.col("scraped") & (F.col("n_chars") > 0))
    band = lambda x, full: F.when(x >= full, 2).when(x >= 1, 1).otherwise(0)
    return F.when(F.count_if(top) == 0, 0).when(F.size(F.first("expected")) > 0, band(hits, 2)).otherwise(band(got, min(2, n)))


@query(_RES + f" SELECT id, {_USE.format(3)} AS usefulness_3, {_USE.format(5)} AS usefulness_5 FROM f GROUP BY id")
def eval_usefulness(spark, sf):
    return _results(spark, sf).groupBy("id").agg(_useful(3).alias("usefulness_3"), _useful(5).alias("usefulness_5"))


_SUM = (
    _RES
    + f""", c AS (SELECT id, domain, count(*) AS c5, count(*) FILTER (rank <= 3) AS c3 FROM f WHERE domain <> '' GROUP BY id, domain), m AS (SELECT id, max(c3)::BIGINT AS concentration_3, max(c5)::BIGINT AS concentration_5 FROM c GROUP BY id),
u AS (SELECT id, 'query ' || id AS query, count(*)::BIGINT AS results_returned, count(*) FILTER (scraped)::BIGINT AS scraped_results, bool_or(NOT scraped) AS degraded, count(*) FILTER (NOT scraped)::BIGINT AS warnings, sum(n_chars)::BIGINT AS latency_ms, count(*) FILTER (rank <= 3 AND hit)::BIGINT AS hits_3, count(*) FILTER (hit)::BIGINT AS hits_5, {_USE.format(3)} AS usefulness_3, {_USE.format(5)} AS usefulness_5 FROM f GROUP BY id),
s AS (SELECT u.*, concentration_3, concentration_5, fresh AS freshness_sensitive, target AS target_3, target AS target_5, coalesce(usefulness_3 >= target, false) AS met_3, coalesce(usefulness_5 >= target, false) AS met_5 FROM u JOIN m USING (id) JOIN j USING (id))"""
)


def _summary(spark, sf):
    r = _results(spark, sf)
    top = F.col("rank") <= 3
    base = r.groupBy("id").agg(
        F.count("*").alias("results_returned"),
        F.count_if("scraped").alias("scraped_results"),
        F.bool_or(~F.col("scraped")).alias("degraded"),
        F.count_if(~F.col("scraped")).alias("warnings"),
        F.sum("n_chars").alias("latency_ms"),
        F.count_if(top & F.col("hit")).alias("hits_3"),
        F.count_if("hit").alias("hits_5"),
        _useful(3).alias("usefulness_3"),
        _useful(5).alias("usefulness_5"),
    )
    s = base.join(_concentration(r, 3), "id").join(_concentration(r, 5), "id").join(_judgments(spark, sf).drop("expected"), "id")
    s = s.withColumns({"query": F.concat(F.lit("query "), "id"), "freshness_sensitive": F.col("fresh"), "target_3": F.col("target"), "target_5": F.col("target")})
    met = {f"met_{n}": F.coalesce(F.col(f"usefulness_{n}") >= F.col(f"target_{n}"), F.lit(False)) for n in (3, 5)}
    return s.withColumns(met).drop("fresh", "target")


@query(_SUM + " SELECT * FROM s")
def eval_query_summary(spark, sf):
    """All measures of each query."""
    return _summary(spark, sf)


MEANS = ("latency_ms", "results_returned", "scraped_results", "concentration_3", "concentration_5", "hits_3", "hits_5", "usefulness_3", "usefulness_5")


@query(
    _SUM
    + " SELECT count(*)::BIGINT AS queries, round(avg(latency_ms), 2) AS latency_ms, round(avg(results_returned), 2) AS results_returned, round(avg(scraped_results), 2) AS scraped_results, round(avg(concentration_3), 2) AS concentration_3, round(avg(concentration_5), 2) AS concentration_5, round(avg(hits_3), 2) AS hits_3, round(avg(hits_5), 2) AS hits_5, round(avg(usefulness_3), 2) AS usefulness_3, round(avg(usefulness_5), 2) AS usefulness_5,"
    " count(*) FILTER (degraded)::BIGINT AS degraded_queries, count(*) FILTER (met_3)::BIGINT AS targets_met_3, count(*) FILTER (met_5)::BIGINT AS targets_met_5, count(*) FILTER (freshness_sensitive)::BIGINT AS freshness_sensitive_queries FROM s"
)
def eval_aggregate(spark, sf):
    counts = {"degraded_queries": "degraded", "targets_met_3": "met_3", "targets_met_5": "met_5", "freshness_sensitive_queries": "freshness_sensitive"}
    return _summary(spark, sf).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 2).alias(c) for c in MEANS], *[F.count_if(c).alias(n) for n, c in counts.items()])


# rendering


@query(
    f"WITH s AS ({Q._SEARCH}), u AS (SELECT s.*, p.url FROM s JOIN pages p USING (page_id)) SELECT E'query: x\nresults: ' || count(*)::VARCHAR || E'\n\nissues:\n- no results found\n\n---\n\n' || string_agg('## ' || rank::VARCHAR || '. [' || coalesce(title, 'Untitled') || '](' || url || E')\n\n_' || CASE WHEN domain <> '' THEN domain || ' | ' ELSE '' END || band || CASE WHEN NOT scraped AND content <> '' THEN ' | snippet only' ELSE '' END || '_' || CASE WHEN content <> '' THEN E'\n\n' || content ELSE '' END, E'\n\n---\n\n' ORDER BY rank) AS markdown FROM u"
)
def render_search(spark, sf):
    """A search's answer as one markdown text (ten results at most): header, issues, sections."""
    r = Q.searched(spark, sf)
    part = T.search_section(F.col("title"), F.col("url"), F.col("rank"), F.col("domain"), F.lit(None).cast("string"), F.col("scraped"), F.col("content"))
    g = r.agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"), F.count("*").alias("n"))
    head = F.concat_ws("\n\n", T.kv_block(("query", F.lit("x")), ("results", F.col("n").cast("string"))), T.issues_block("issues", F.array(T.issue_line(F.lit("no_results"), F.lit("")))))
    return g.select(F.concat(head, F.lit("\n\n---\n\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n---\n\n")).alias("markdown"))
