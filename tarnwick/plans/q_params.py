"""Queries of parameter checks, keyed values, caches and connectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.functions import validate as V
from tarnwick.operators import rank as R
from tarnwick.operators import state as K
from tarnwick.plans import q_scalar as S
from tarnwick.plans.base import query, table
from tarnwick.session import shared_dir
from tarnwick.sources import files

# parameters

_Q = "CASE event_id % 4 WHEN 0 THEN '  ' || event_type || ' ' WHEN 1 THEN '   ' WHEN 2 THEN '' ELSE event_type END"


@query(f"SELECT event_id, nullif(trim({_Q}), '') AS value, trim({_Q}) = '' AS refused FROM events")
def validate_query(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("  "), "event_type", F.lit(" "))).when(k == 1, "   ").when(k == 2, "").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", V.query(raw).alias("value")).withColumn("refused", F.col("value").isNull())


@query("SELECT event_id, n, CASE WHEN n < 1 THEN 'num_results must be >= 1' WHEN n > 10 THEN 'num_results must be <= 10' END AS problem FROM (SELECT event_id, (event_id % 14 - 1)::BIGINT AS n FROM events)")
def validate_count(spark, sf):
    n = F.col("event_id") % 14 - 1
    return table(spark, sf, "events").select("event_id", n.alias("n"), V.positive("num_results", n, V.MOST["num_results"]).alias("problem"))


_U = "CASE page_id % 6 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN 'ftp' || substr(url, 5) WHEN 2 THEN 'http://127.0.0.1/' || page_id::VARCHAR WHEN 3 THEN 'http:///x' WHEN 4 THEN 'http://[::1]/' ELSE url END"


@query(f"SELECT page_id, CASE WHEN page_id % 6 IN (0, 5) THEN trim({_U}) END AS value, page_id % 6 NOT IN (0, 5) AS refused FROM pages")
def validate_url(spark, sf):
    k = F.col("page_id") % 6
    raw = F.when(k == 0, F.concat(F.lit(" "), "url", F.lit(" "))).when(k == 1, F.concat(F.lit("ftp"), F.expr("substr(url, 5)"))).when(k == 2, F.concat(F.lit("http://127.0.0.1/"), F.col("page_id").cast("string"))).when(k == 3, "http:///x").when(k == 4, "http://[::1]/").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", V.url(raw).alias("value")).withColumn("refused", F.col("value").isNull())


@query("WITH h(k, host, blocked) AS (VALUES (0, '10.1.2.3', true), (1, '8.8.8.8.', false), (2, 'LOCALHOST.', true), (3, 'a.localhost', true), (4, '::1', true), (5, 'fe80::1', true), (6, '2001:db8::1', true), (7, '2606:4700::1111', false), (8, '::ffff:192.168.0.1', true), (9, 'example.org', false), (10, '0.0.0.0', true), (11, '::', true), (12, 'ff02::1', true), (13, 'fc00::5', true)) SELECT page_id, host, blocked FROM pages JOIN h ON page_id % 14 = k")
def target_guard(spark, sf):
    """Local and reserved targets of both address families, with trailing dots."""
    hosts = ("10.1.2.3", "8.8.8.8.", "LOCALHOST.", "a.localhost", "::1", "fe80::1", "2001:db8::1", "2606:4700::1111", "::ffff:192.168.0.1", "example.org", "0.0.0.0", "::", "ff02::1", "fc00::5")
    p = table(spark, sf, "pages").select("page_id", F.get(F.array(*map(F.lit, hosts)), (F.col("page_id") % 14).cast("int")).alias("host"))
    return p.withColumn("blocked", U.ip_blocked(F.col("host")))


_R = "CASE event_id % 6 WHEN 0 THEN '\"Day\"' WHEN 1 THEN 'week' WHEN 2 THEN 'none' WHEN 3 THEN ' MONTH ' WHEN 4 THEN 'decade' ELSE 'year' END"


@query(f"WITH r AS (SELECT event_id, lower(trim(trim(trim({_R}), '\"'))) AS v FROM events) SELECT event_id, CASE WHEN v IN ('day', 'week', 'month', 'year') THEN v END AS time_range, v NOT IN ('none', 'day', 'week', 'month', 'year') AS refused FROM r")
def validate_time_range(spark, sf):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, '"Day"').when(k == 1, "week").when(k == 2, "none").when(k == 3, " MONTH ").when(k == 4, "decade").otherwise("year")
    value, refused = V.time_range(raw)
    return table(spark, sf, "events").select("event_id", value.alias("time_range"), refused.alias("refused"))


@query("WITH r(time_range, since) AS (SELECT 'day', max(ts) - INTERVAL 1 DAY FROM events UNION ALL SELECT 'week', max(ts) - INTERVAL 7 DAY FROM events UNION ALL SELECT 'month', max(ts) - INTERVAL 1 MONTH FROM events UNION ALL SELECT 'year', max(ts) - INTERVAL 1 YEAR FROM events) SELECT time_range, count(event_id)::BIGINT AS n FROM r LEFT JOIN events ON ts >= since GROUP BY time_range")
def time_ranges(spark, sf):
    """What each time range lets through."""
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    counts = [F.count_if(F.col("ts") >= V.since(F.col("now"), F.lit(r))).alias(r) for r in V.TIME_RANGES]
    row = e.select("ts").crossJoin(F.broadcast(now)).agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("time_range"), F.col(r).alias("n")) for r in V.TIME_RANGES])).alias("x")).select("x.*")


@query("WITH d AS (SELECT n_nationkey, n_regionkey, 'www.' || lower(replace(n_name, ' ', '-')) || '.org' AS d FROM nation) SELECT n_regionkey, string_agg(regexp_replace(d, '^www\\.', ''), ',' ORDER BY n_nationkey) || CASE WHEN n_regionkey = 0 THEN ',a/b' ELSE '' END AS domains, n_regionkey = 0 AS refused FROM d GROUP BY n_regionkey")
def normalize_domains(spark, sf):
    """Distinct canonical domains in their order; an entry with a slash refuses the call."""
    d = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit(" WWW."), d, F.lit(".ORG. ")).alias("d")))).alias("l"))
    raw = F.transform("l", lambda x: x["d"])
    raw = F.concat(raw, F.array(F.lit("  ")), raw, F.when(F.col("n_regionkey") == 0, F.array(F.lit("a/b"))).otherwise(F.array().cast("array<string>")))
    value, refused = V.domains(raw)
    return g.select("n_regionkey", F.array_join(value, ",").alias("domains"), refused.alias("refused"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE '*/' || lower(r_name) || '/*' END AS patterns, r_regionkey % 2 = 0 AS refused FROM region")
def normalize_globs(spark, sf):
    blank = F.array(F.lit(" "), F.lit(""))
    raw = F.when(F.col("r_regionkey") % 2 == 0, blank).otherwise(F.array(F.lit(""), F.concat(F.lit(" */"), F.lower("r_name"), F.lit("/* "))))
    value, refused = V.globs(raw)
    return table(spark, sf, "region").select("r_regionkey", F.array_join(value, ",").alias("patterns"), refused.alias("refused"))


@query("SELECT event_id, event_id % 5 <> 0 AS ok FROM events")
def validate_chunk_ids(spark, sf):
    ids = F.array(F.lit(3), F.when(F.col("event_id") % 5 == 0, -1).otherwise(0))
    return table(spark, sf, "events").select("event_id", V.chunk_ids(ids).alias("ok"))


@query("SELECT doc_id::INT AS id, text AS content, lang, n_chars::INT AS total_chars, NULL::VARCHAR AS title FROM documents")
def output_schema(spark, sf):
    """Rows in a closed schema: cast, missing fields null, others dropped."""
    d = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "text": "content", "n_chars": "total_chars"})
    return files.conform(d, "id int, content string, lang string, total_chars int, title string")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = 'example.org' OR ends_with(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.example.org')")
def site_prefix(spark, sf):
    """A query's ``site:`` prefix as a domain predicate."""
    site = F.regexp_extract(F.lit("site:example.org heth"), r"(?:^|\s)site:(\S+)", 1)
    return table(spark, sf, "pages").where(U.matches(U.domain(F.col("url")), site)).select("page_id")


# keyed values: events are get, set (with and without an own time to live) and delete calls on a user's key

_OPS = """o AS (SELECT event_id, user_id, event_type, epoch_us(ts)::DOUBLE / 1000000 AS t, CASE event_id % 5 WHEN 2 THEN 'set' WHEN 3 THEN 'set' WHEN 4 THEN 'delete' ELSE 'get' END AS op,
 CASE WHEN event_id % 5 = 3 THEN (event_id % 2) * 86400 WHEN event_id % 5 = 2 THEN 3600 END AS ttl FROM events),
w AS (SELECT *, CASE WHEN op = 'delete' OR (op = 'set' AND ttl > 0) THEN {'op': op, 'until': t + coalesce(ttl, 0), 'value': event_id} END AS wr FROM o),
l AS (SELECT *, last_value(wr IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w),
g AS (SELECT event_id, event_type, CASE WHEN p.op = 'set' AND t < p.until THEN p.value END AS value FROM l WHERE op = 'get')"""


def _calls(spark, sf, ttl: int = K.TTL):
    k = F.col("event_id") % 5
    op = F.when(k.isin(2, 3), "set").when(k == 4, "delete").otherwise("get")
    own = F.when(k == 3, (F.col("event_id") % 2 * 86400).cast("int"))
    return K.keyed_values(table(spark, sf, "events").withColumns({"op": op, "own": own}), ["user_id"], "op", F.col("event_id"), F.col("own"), ["event_id"], ttl)


@query(f"WITH {_OPS} SELECT event_id, value, value IS NOT NULL AS hit FROM g")
def kv_get(spark, sf):
    """What each get finds: the last value set, unless it was deleted or has expired."""
    return _calls(spark, sf).where("op = 'get'").select("event_id", F.col("found").alias("value"), F.col("found").isNotNull().alias("hit"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 3600 ELSE 86400 END::INT AS ttl FROM events WHERE event_id % 5 = 2 OR (event_id % 5 = 3 AND event_id % 2 = 1)")
def kv_set(spark, sf):
    """The writes that are made: an own time to live wins even if larger, and zero writes nothing."""
    return _calls(spark, sf).where("op = 'set' and ttl > 0").select("event_id", "ttl")


@query(f"WITH {_OPS} SELECT event_type AS namespace, count(value)::BIGINT AS hits, (count(*) - count(value))::BIGINT AS misses FROM g GROUP BY event_type")
def kv_stats(spark, sf):
    """Hits and misses of gets in each namespace; sets, deletes and contains don't count."""
    got = _calls(spark, sf).where("op = 'get'")
    return got.groupBy(F.col("event_type").alias("namespace")).agg(F.count("found").alias("hits"), F.count_if(F.col("found").isNull()).alias("misses"))


@query(f"WITH {_OPS} SELECT event_id, coalesce(p.op = 'set' AND t < p.until, false) AS present FROM l WHERE op = 'delete'")
def kv_contains(spark, sf):
    """Whether a key is there when it is deleted."""
    return _calls(spark, sf).where("op = 'delete'").select("event_id", F.col("found").isNotNull().alias("present"))


@query("SELECT event_id, NULL::BIGINT AS value FROM events WHERE event_id % 5 IN (0, 1)")
def kv_disabled(spark, sf):
    """With a time to live of zero nothing is written and every get misses."""
    calls = _calls(spark, sf, ttl=0).where("op = 'get'")
    return calls.select("event_id", F.col("found").alias("value"))


_SKEY = "event_type || '|' || (event_id % 3)::VARCHAR"


@query(
    f"""WITH RECURSIVE o AS (SELECT event_id, {_SKEY} AS k, row_number() OVER (PARTITION BY {_SKEY} ORDER BY ts, event_id) AS i, epoch_us(ts)::DOUBLE / 1000000 AS t FROM events),
r AS (SELECT event_id, k, i, t + 3600 AS until, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.k, o.i, CASE WHEN o.t < r.until THEN r.until ELSE o.t + 3600 END, o.t < r.until FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT event_id, hit FROM r"""
)
def search_cache(spark, sf):
    """Which searches are answered from the cache: one entry for each key, whatever the domain filters, read at their time."""
    e = table(spark, sf, "events").withColumn("k", F.concat_ws("|", F.lower(F.trim("event_type")), (F.col("event_id") % 3).cast("string")))
    return K.replayed(e, ["k"], F.lit(3600), ["event_id"]).select("event_id", "hit")


@query("SELECT event_id, ts, leader, event_id <> leader AS shared FROM (SELECT event_id, ts, min(event_id) OVER (PARTITION BY event_type, date_trunc('minute', ts)) AS leader FROM events)")
def single_flight(spark, sf):
    """Identical requests of one minute share the call of the first."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", F.date_trunc("minute", "ts").alias("m"))
    lead = e.groupBy("event_type", "m").agg(F.min("event_id").alias("leader"))
    return e.join(lead, ["event_type", "m"]).select("event_id", "ts", "leader", (F.col("event_id") != F.col("leader")).alias("shared"))


@query(f"WITH n AS (SELECT page_id, normalized FROM ({S.QUERY_NORMALIZE})) SELECT page_id, coalesce(normalized IN (SELECT normalized FROM n WHERE page_id % 3 = 0), false) AS previously_seen FROM n")
def seen_mark(spark, sf):
    """All pages, and whether their normalised url is in the stored state, which a third of them has been put into."""
    n = S.url_normalize(spark, sf)
    state = n.where("page_id % 3 = 0").select("normalized").distinct().withColumn("there", F.lit(True))
    return n.join(state, "normalized", "left").select("page_id", F.coalesce("there", F.lit(False)).alias("previously_seen"))


# connectors


def _written(spark, df, write):
    """A table written to the shared folder by a sink, for a reader to read."""
    at = f"{shared_dir(spark)}/connector-{uuid.uuid4().hex}"
    write(df, at)
    return at


@query("SELECT event_id, event_type, value FROM events")
def jsonl_roundtrip(spark, sf):
    """The JSON lines sink, and its reader (blank lines are skipped)."""
    at = _written(spark, table(spark, sf, "events").select("event_id", "event_type", "value"), files.write_json_lines)
    return files.json_lines(spark, at, "event_id long, event_type string, value double")


@query("SELECT 'q' || r_regionkey::VARCHAR AS id, lower(r_name) AS query, r_regionkey % 2 = 0 AS freshness_sensitive FROM region")
def query_specs(spark, sf):
    """The evaluation queries of a JSON array."""
    row = F.struct(F.concat(F.lit("q"), F.col("r_regionkey").cast("string")).alias("id"), F.lower("r_name").alias("query"), F.struct((F.col("r_regionkey") % 2 == 0).alias("freshness_sensitive")).alias("judgments"))
    doc = table(spark, sf, "region").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))  # five queries
    at = _written(spark, doc, lambda df, path: df.coalesce(1).write.text(path))
    return files.query_specs(spark, at).select("id", "query", F.col("judgments.freshness_sensitive").alias("freshness_sensitive"))


@query("SELECT length(string_agg('- ' || r_name, '\n' ORDER BY r_regionkey) || '\n')::INT AS total_chars, sum(1 + len(string_split(r_name, ' ')))::BIGINT AS word_count, 'ok' AS status FROM region")
def text_document(spark, sf):
    """A text file as it is, with its words counted."""
    lines = table(spark, sf, "region").coalesce(1).sortWithinPartitions("r_regionkey").select(F.concat_ws(" ", F.lit("-"), "r_name").alias("value"))
    at = _written(spark, lines, lambda df, path: df.write.text(path))
    return files.raw_text(spark, at).select(F.length("content").alias("total_chars"), T.word_count(F.col("content")).alias("word_count"), F.lit("ok").alias("status"))


@query("WITH l AS (SELECT user_id AS stream, event_id AS line_no, event_id % 7 AS k FROM events), stop AS (SELECT stream, min(line_no) AS s FROM l WHERE k = 6 GROUP BY stream) SELECT l.stream, line_no, 'http://x/' || line_no::VARCHAR AS url FROM l LEFT JOIN stop ON l.stream = stop.stream WHERE k NOT IN (0, 1, 6) AND (s IS NULL OR line_no < s)")
def crawl_lines(spark, sf):
    """Rows of crawl streams up to the line that says completed; blank lines and junk are skipped."""
    k = F.col("event_id") % 7
    value = F.when(k == 0, "").when(k == 1, "[1]").when(k == 6, '{"status":"completed"}').otherwise(F.concat(F.lit('{"url":"http://x/'), F.col("event_id").cast("string"), F.lit('"}')))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("line_no"), value.alias("value"))
    return files.crawl_stream(lines).select("stream", "line_no", "url")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'one' WHEN 2 THEN 'self' END AS url FROM events WHERE event_id % 4 <> 3")
def crawl_unwrap(spark, sf):
    """The result of an envelope: the first of ``results``, else ``result``, else the answer itself; an empty list has none."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"results":[{"url":"list"},7]}').when(k == 1, '{"result":{"url":"one"}}').when(k == 2, '{"url":"self"}').otherwise('{"results":[]}')
    return files.unwrap(table(spark, sf, "events").select("event_id", raw.alias("value")), "value").select("event_id", F.try_variant_get("result", "$.url", "string").alias("url"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN (event_id % 5 = 1) WHEN event_id % 5 = 2 THEN true WHEN event_id % 5 = 3 THEN true ELSE false END AS retry FROM events")
def retryable_errors(spark, sf):
    k = F.col("event_id") % 5
    status = F.when(k == 0, 404).when(k == 1, 503)
    error = F.when(k == 2, "transport").when(k == 3, "timeout").when(k == 4, "payload")
    return table(spark, sf, "events").select("event_id", U.retryable(status, error).alias("retry"))


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE CASE WHEN contains(url, '.html') THEN 'html' WHEN page_id % 5 = 2 THEN 'text' WHEN page_id % 2 = 0 AND strlen(html) <= 8192 THEN 'html' ELSE 'unknown' END END AS file_type, {S._CT} AS head FROM pages")
def detect_type(spark, sf):
    """Types by the head's answer; without one by the suffix, and then by the first bytes of a partial answer, unless that is too long."""
    head = S._content_type()
    p = table(spark, sf, "pages")
    return p.select("page_id", U.detected(F.col("url"), F.nullif(F.trim(head), F.lit("")), F.encode("html", "UTF-8"), F.when(F.col("page_id") % 2 == 0, 206).otherwise(200)).alias("file_type"), head.alias("head"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'image/png' ELSE CASE WHEN strlen(html) <= 8192 THEN 'text/html' END END END AS sniffed FROM pages")
def sniff_type(spark, sf):
    """Signatures of the first bytes, of partial answers of up to 8,192 bytes only."""
    k = F.col("page_id") % 6
    body = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 2, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.encode("html", "UTF-8"))
    return table(spark, sf, "pages").select("page_id", U.sniffed(body, F.when(F.col("page_id") % 2 == 0, 206).otherwise(200)).alias("sniffed"))


@query("WITH s AS (SELECT event_type AS dependency, count(*) FILTER (value < 0 OR event_type = 'error') = 0 AS ok FROM events GROUP BY event_type) SELECT dependency, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, bool_and(ok) OVER () AS ready, CASE WHEN bool_and(ok) OVER () THEN 200 ELSE 503 END::INT AS code FROM s")
def health(spark, sf):
    """The state of each dependency, and ready only if all are well."""
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("dependency")).agg((F.count_if((F.col("value") < 0) | (F.col("event_type") == "error")) == 0).alias("ok"))
    ready = s.agg(F.bool_and("ok").alias("ready"))  # one row
    return s.crossJoin(F.broadcast(ready)).select("dependency", F.when(F.col("ok"), "ok").otherwise("error").alias("status"), "ready", F.when(F.col("ready"), 200).otherwise(503).alias("code"))


# The engines that are asked, and their weights.
ENGINES = {
    "google": 0.5,
    "google news": 0.5,
    "bing": 1.5,
    "bing news": 1.0,
    "duckduckgo": 1.5,
    "duckduckgo news": 1.0,
    "startpage": 1.3,
    "mojeek": 1.3,
    "stackoverflow": 1.2,
    "wikipedia": 1.3,
    "github": 1.2,
    "arxiv": 1.2,
}


@query(
    """WITH e(engine, weight) AS (VALUES ('google', 0.5::DOUBLE), ('google news', 0.5), ('bing', 1.5), ('bing news', 1.0), ('duckduckgo', 1.5), ('duckduckgo news', 1.0), ('startpage', 1.3), ('mojeek', 1.3), ('stackoverflow', 1.2), ('wikipedia', 1.3), ('github', 1.2), ('arxiv', 1.2)),
n AS (SELECT engine, weight, row_number() OVER (ORDER BY engine) - 1 AS i FROM e), h AS (SELECT page_id, engine, weight, row_number() OVER (PARTITION BY engine ORDER BY page_id) AS pos FROM pages JOIN n ON page_id % 13 = i OR page_id % 11 = i)
SELECT page_id, round(sum(weight / pos), 6) AS score, count(*)::BIGINT AS engines FROM h GROUP BY page_id"""
)
def engine_fusion(spark, sf):
    """Results of the allowed engines, merged by weighted reciprocal ranks; others are dropped by the join."""
    rows = [(name, weight, i) for i, (name, weight) in enumerate(sorted(ENGINES.items()))]
    engines = spark.createDataFrame(rows, "engine string, weight double, i long")
    asked = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.array(F.col("page_id") % 13, F.col("page_id") % 11))).alias("i"))
    hits = R.ranked_within(asked.join(F.broadcast(engines), "i"), "engine", F.col("page_id"), name="pos")
    return hits.groupBy("page_id").agg(F.round(F.sum(F.col("weight") / F.col("pos")), 6).alias("score"), F.count("*").alias("engines"))


@query(f"WITH {S.LINKS} SELECT page_id, pos, target FROM r WHERE regexp_matches(target, '^https?://([^/]*\\.)?example\\.(org|com)/') AND target GLOB '*e*'")
def crawl_scope(spark, sf):
    """Links that a crawl may follow: in the registrable domain of either seed, and fitting a glob."""
    e = S.page_edges(table(spark, sf, "pages")).withColumn("target", U.resolve(F.col("url"), F.col("href"))).where("target is not null")
    t = F.col("target")
    return e.where(U.in_scope(t, "http://docs.example.org/a", include=["*e*"]) | U.in_scope(t, "http://www.example.com", include=["*e*"])).select("page_id", "pos", "target")


@query("SELECT user_id, count(*) FILTER (event_type = 'error')::BIGINT AS scrape_failures, count(*)::BIGINT AS num_results, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def result_counts(spark, sf):
    """Counts that an answer's meta states: results and failed scrapes."""
    e = table(spark, sf, "events").withColumn("content", F.when(F.col("event_type") != "error", F.col("props")))
    return e.groupBy("user_id").agg(F.count_if(F.col("content").isNull()).alias("scrape_failures"), F.count("*").alias("num_results"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("WITH w AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('error', 'signup')) SELECT user_id, string_agg(event_type || '@' || event_id::VARCHAR, ';' ORDER BY event_id) AS warnings FROM w GROUP BY user_id")
def warning_list(spark, sf):
    """All warnings of a request in the order in which they came up."""
    w = table(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    g = w.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    return g.select("user_id", F.array_join(F.transform("l", lambda x: F.concat_ws("@", x["event_type"], x["event_id"].cast("string"))), ";").alias("warnings"))
