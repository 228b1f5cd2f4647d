"""Queries of metadata, renderers and evaluation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.plans import q_scalar as S
from tarnwick.plans.base import query, table

# metadata


def _meta(name: str, attr: str = "name") -> str:
    return f"nullif(trim(regexp_extract(h, '(?is)<meta[^>]*\\b{attr}\\s*=\\s*[\"'']{name}[\"''][^>]*\\bcontent\\s*=\\s*[\"'']([^\"'']*)', 1)), '')"


_HEAD = "p AS (SELECT page_id, url, replace(html, '<meta charset=\"utf-8\">', '<meta charset=\"utf-8\"><meta name=\"author\" content=\" A' || page_id::VARCHAR || '\"><meta property=\"article:published_time\" content=\"2024-0' || (page_id % 9 + 1)::VARCHAR || '-01T00:00\"><meta property=\"og:site_name\" content=\"S\">') AS h FROM pages)"


def _headed(spark, sf):
    k = F.col("page_id").cast("string")
    more = F.concat(F.lit('<meta charset="utf-8"><meta name="author" content=" A'), k, F.lit('"><meta property="article:published_time" content="2024-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('-01T00:00"><meta property="og:site_name" content="S">'))
    return table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit('<meta charset="utf-8">'), more))


@query(f"WITH {_HEAD} SELECT page_id, {_meta('author')} AS author, nullif(regexp_extract(coalesce({_meta('article:published_time', 'property')}, ''), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS date, {_meta('og:site_name', 'property')} AS site_name, {_meta('description')} AS description FROM p")
def html_metadata(spark, sf):
    """Author, date, site and description as the pages' heads state them."""
    return _headed(spark, sf).select("page_id", T.html_citation(F.col("html")).alias("m")).select("page_id", "m.*")


@query(f"WITH {_HEAD}, t AS (SELECT page_id, {_meta('author')} AS author, {S.TEXT.replace('html', 'h')} AS content FROM p) SELECT page_id, author, nullif({S._WC.format('content')}, 0) AS word_count FROM t")
def document_metadata(spark, sf):
    """Citation metadata with the words of the content; absent entries are null."""
    p = _headed(spark, sf).withColumn("content", T.strip_tags(F.col("html")))
    return p.select("page_id", T.html_citation(F.col("html"))["author"].alias("author"), F.nullif(T.word_count(F.col("content")), F.lit(0).cast("long")).alias("word_count"))


@query(f"WITH p AS (SELECT page_id, {S.TEXT} AS c FROM pages), x AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'short' ELSE c END AS ext, CASE WHEN page_id % 6 = 0 THEN 'fit [a](b)' ELSE '' END AS fit, c FROM p) SELECT page_id, sha256(trim(CASE WHEN length(trim(ext)) >= 50 THEN ext WHEN fit <> '' THEN fit ELSE 'raw: ' || c END, '\n')) AS markdown FROM x")
def page_markdown(spark, sf):
    """A page's text: the extracted one if it isn't tiny, else the crawler's fitted, raw, plain or cleaned form; then cleaned."""
    c, k = T.strip_tags(F.col("html")), F.col("page_id")
    best = T.best_markdown(F.when(k % 3 == 0, "short").otherwise(c), F.when(k % 6 == 0, "fit [a](b)").otherwise(""), F.concat(F.lit("raw: "), c), F.lit(""), F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.sha2(T.clean_markdown(T.strip_table_rows(best)), 256).alias("markdown"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) > 120 THEN left(f, 119) || '…' ELSE f END AS preview FROM t")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS engine, event_id % 3 = 0 AS engine_warning FROM events")
def header_lines(spark, sf):
    """Values of a rendered answer's header, and warnings that name an engine (one token before a colon)."""
    even = F.col("event_id") % 2 == 0
    text = F.concat(F.lit("query: x"), F.when(even, F.concat(F.lit("\nengine: "), "event_type")).otherwise(""), F.lit("\n---\nengine: late"))
    warning = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(": timeout"))).otherwise(F.concat("event_type", F.lit(" failed: timeout")))
    return table(spark, sf, "events").select("event_id", T.header_value(text, "engine").alias("engine"), warning.rlike("^[^ :]+:").alias("engine_warning"))


@query(f"WITH pg AS (SELECT doc_id, replace(text, '\n', E'\\n\\n') AS t FROM documents), {S.chunks_sql('pg', 'doc_id', 't')} SELECT doc_id, unnest(range(0, len(b)))::INT AS chunk_id, unnest(b) AS chunk FROM rc")
def chunk_paragraphs(spark, sf):
    """Lines taken as paragraphs: whole up to 1000 characters, longer ones split."""
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return S.recursive_rows(d, "t")


# renderers

_META = """CASE WHEN doc_id % 3 = 1 THEN 'type: pdf | ' WHEN doc_id % 3 = 2 THEN 'content_type: text/plain | ' ELSE '' END || 'chunks: ' || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '0..2, 5 of ' ELSE '4 of ' END || '0..' || (6 + doc_id % 5)::VARCHAR
 || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' | mode: relevant' WHEN 2 THEN ' | mode: selected' ELSE ' | mode: document' END || CASE WHEN n_chars > 0 THEN ' | ' || format('{:,}', least(n_chars, 1500)) || ' of ' || format('{:,}', n_chars) || ' chars' ELSE '' END"""


def _documents(spark, sf):
    """Documents as answers of an extraction."""
    k = F.col("doc_id") % 4
    ids = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(5), F.lit(0), F.lit(2), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(4)))
    third = F.col("doc_id") % 3
    meta = T.meta_line(F.when(third == 1, "pdf").otherwise("html"), F.when(third == 2, "text/plain").otherwise("text/html"), ids, (F.col("doc_id") % 5 + 7).cast("int"), F.when(k == 1, "relevant").when(k == 2, "selected").when(k == 3, "document"), F.least(F.col("n_chars"), F.lit(1500)), F.col("n_chars"))
    status = F.when(F.col("doc_id") % 7 == 0, "error").when(F.col("doc_id") % 7 == 1, "handoff").otherwise("ok")
    d = table(spark, sf, "documents").withColumns({"meta": meta, "status": status, "url": F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")), "content": F.when(status == "ok", F.left("text", F.lit(1500))).otherwise("")})
    return d


@query(f"SELECT doc_id, {_META} AS meta FROM documents")
def document_meta_line(spark, sf):
    return _documents(spark, sf).select("doc_id", "meta")


_SECTION = f"""'## [' || CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id::VARCHAR ELSE 'Untitled' END || '](http://x/' || doc_id::VARCHAR || ')' || E'\n\n_' || {_META} || '_'
 || CASE doc_id % 7 WHEN 0 THEN E'\n\n**Error:** timeout' WHEN 1 THEN E'\n\n**Handoff:** `pdf` content should be handled by the `files` MCP.\n\ndelegated to another MCP' ELSE CASE WHEN text <> '' THEN E'\n\n' || left(text, 1500) ELSE '' END END"""


def _section():
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    return T.document_section(title, F.col("url"), F.col("status"), F.col("content"), F.lit("timeout"), F.lit("pdf"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("meta"))


@query(f"SELECT doc_id, {_SECTION} AS section FROM documents")
def document_section(spark, sf):
    """One extracted document as markdown: its meta line, then its content, error or hand-off."""
    return _documents(spark, sf).select("doc_id", _section().alias("section"))


def _joined(df, group: str, order: str, part, by: str):
    """The parts of a group (an answer of at most 20 documents) in order, as one text."""
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("p")))).alias("ps"))
    return g.select(group, F.array_join(F.transform("ps", lambda x: x["p"]), by).alias("body"))


_TWENTY = "d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20)"


def _answers(spark, sf):
    from tarnwick.operators import rank as R

    return R.top_k(_documents(spark, sf), "source", 20, F.col("doc_id"))


@query(
    f"WITH {_TWENTY} SELECT source, 'query: x' || CASE WHEN count(*) <> 1 OR bool_or(doc_id % 7 = 0) THEN E'\nsucceeded: ' || count(*) FILTER (doc_id % 7 <> 0)::VARCHAR ELSE '' END || CASE WHEN bool_or(doc_id % 7 = 0) THEN E'\nfailed: ' || count(*) FILTER (doc_id % 7 = 0)::VARCHAR ELSE '' END || E'\n\n---\n\n' || string_agg({_SECTION}, E'\n\n---\n\n' ORDER BY doc_id) AS markdown FROM d GROUP BY source"
)
def render_extract(spark, sf):
    """An extraction's answer: counts, then a section for each document."""
    d = _answers(spark, sf)
    counts = d.groupBy("source").agg(F.count_if(F.col("status") != "error").alias("good"), F.count_if(F.col("status") == "error").alias("bad"), F.count("*").alias("n"))
    head = T.kv_block(("query", F.lit("x")), ("succeeded", F.when((F.col("n") != 1) | (F.col("bad") > 0), F.col("good").cast("string"))), ("failed", F.when(F.col("bad") > 0, F.col("bad").cast("string"))))
    body = _joined(d, "source", "doc_id", _section(), "\n\n---\n\n")
    return counts.join(body, "source").select("source", F.concat_ws("\n\n---\n\n", head, "body").alias("markdown"))


_TREE = "CASE WHEN rank = 1 THEN '' ELSE '  ' END || '- [' || coalesce(nullif(label, ''), target) || '](' || target || ')' || CASE WHEN link_type = 'external' THEN ' (ext)' ELSE '' END"


@query(
    f"""WITH {S.LINKS}, f AS (SELECT page_id, url, target, min(pos) AS pos, arg_min(label, pos) AS label FROM r WHERE regexp_matches(target, '^https?://[^/?#]+') GROUP BY ALL),
k AS (SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY pos) + 1 AS rank, trim(label) AS label, CASE WHEN lower(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1)) = lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) THEN 'internal' ELSE 'external' END AS link_type FROM f),
t AS (SELECT page_id, url AS target, 1 AS rank, NULL AS label, 'seed' AS link_type FROM pages UNION ALL SELECT page_id, target, rank, label, link_type FROM k WHERE rank <= 6)
SELECT page_id, string_agg({_TREE}, E'\n' ORDER BY rank) AS markdown FROM t GROUP BY page_id"""
)
def render_map(spark, sf):
    """A site's tree as indented links; those that leave the site are marked."""
    from tarnwick.plans import q_state

    t = q_state._tree(spark, sf)
    ext = F.lower(U.part(F.col("target"), 2)) != F.lower(U.part(F.coalesce("discovered_from", "target"), 2))
    line = T.tree_line(F.lit(None).cast("string"), F.col("label"), F.col("target"), F.col("depth"), F.when(ext, "external").otherwise(F.col("link_type")))
    return _joined(t, "page_id", "rank", line, "\n").select("page_id", F.col("body").alias("markdown"))


@query(
    f"WITH {_TWENTY} SELECT source, E'warnings:\n- partial\n\nquery: x\ndiscovered: ' || count(*)::VARCHAR || E'\nextracted: ' || count(*) FILTER (doc_id % 7 <> 0)::VARCHAR || CASE WHEN bool_or(doc_id % 7 = 0) THEN E'\nfailed: ' || count(*) FILTER (doc_id % 7 = 0)::VARCHAR ELSE '' END || E'\n\nmap:\n' || string_agg('- [http://x/' || doc_id::VARCHAR || '](http://x/' || doc_id::VARCHAR || ')', E'\n' ORDER BY doc_id) || E'\n\n---\n\n' || string_agg({_SECTION}, E'\n\n---\n\n' ORDER BY doc_id) AS markdown FROM d GROUP BY source"
)
def render_crawl(spark, sf):
    """A crawl's answer: warnings, summary, map and the documents."""
    d = _answers(spark, sf)
    counts = d.groupBy("source").agg(F.count_if(F.col("status") != "error").alias("good"), F.count_if(F.col("status") == "error").alias("bad"), F.count("*").alias("n"))
    summary = T.kv_block(("query", F.lit("x")), ("discovered", F.col("n").cast("string")), ("extracted", F.col("good").cast("string")), ("failed", F.when(F.col("bad") > 0, F.col("bad").cast("string"))))
    none = F.lit(None).cast("string")
    tree = _joined(d, "source", "doc_id", T.tree_line(none, none, F.col("url"), F.lit(0), F.lit("internal")), "\n").withColumnRenamed("body", "tree")
    body = _joined(d, "source", "doc_id", _section(), "\n\n---\n\n")
    head = F.concat_ws("\n\n", T.issues_block("warnings", F.array(F.lit("partial"))), summary, F.concat(F.lit("map:\n"), "tree"))
    return counts.join(tree, "source").join(body, "source").select("source", F.concat_ws("\n\n---\n\n", head, "body").alias("markdown"))


@query(
    "WITH k AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'scrape_failed' WHEN 1 THEN 'low_relevance_filtered' WHEN 2 THEN 'search_failed' WHEN 3 THEN 'rerank_failed' WHEN 4 THEN 'engine_unresponsive' WHEN 5 THEN 'no_results' ELSE 'other' END AS kind, event_type AS d FROM events)"
    " SELECT event_id, CASE kind WHEN 'scrape_failed' THEN 'partial scrape: ' || d || ' — snippet used instead' WHEN 'low_relevance_filtered' THEN 'filtered low-relevance results: ' || d WHEN 'search_failed' THEN 'search backend failed: ' || d WHEN 'rerank_failed' THEN 'reranker failed: ' || d WHEN 'engine_unresponsive' THEN 'upstream engine unavailable: ' || d WHEN 'no_results' THEN 'no results found' ELSE d END AS line FROM k"
)
def issue_lines(spark, sf):
    """What is said of each warning."""
    kinds = F.array(*[F.lit(x) for x in ("scrape_failed", "low_relevance_filtered", "search_failed", "rerank_failed", "engine_unresponsive", "no_results", "other")])
    return table(spark, sf, "events").select("event_id", T.issue_line(F.get(kinds, (F.col("event_id") % 7).cast("int")), F.col("event_type")).alias("line"))
