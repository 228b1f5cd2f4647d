"""Queries of the scalar functions and predicates over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.functions.chunks import chunk_recursive as recursive_chunks
from tarnwick.operators import suffixes
from tarnwick.plans.base import query, table

HOST = "lower(regexp_extract(regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^(?:.*@)?([^:@]*)', 1))"
PATH = "regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"
# The SQL states its own values: it doesn't read them from the functions that it checks.
TRACK = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid'"
TWO = "'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'co.nz', 'com.br', 'co.in', 'co.za', 'com.mx', 'com.cn', 'com.tr', 'co.kr'"


def tail(host: str, n: int) -> str:
    """The last n labels of a host."""
    return f"array_to_string(list_slice(string_split({host}, '.'), greatest(len(string_split({host}, '.')) - {n - 1}, 1), len(string_split({host}, '.'))), '.')"


#: Hosts of the test tables end in com, org, net and country codes; others have no known suffix.
ONE = "'com', 'org', 'net', 'edu', 'gov', 'info', 'io', 'dev', 'uk', 'de', 'fr', 'es', 'it', 'jp', 'au', 'br', 'in', 'za', 'nz', 'ch', 'at', 'nl'"
REG = f"CASE WHEN regexp_full_match(h, '[0-9.]+') THEN h WHEN {tail('h', 2)} IN ({TWO}) THEN {tail('h', 3)} WHEN {tail('h', 1)} IN ({ONE}) THEN {tail('h', 2)} ELSE h END"


QUERY_NORMALIZE = f"""WITH p AS (SELECT page_id, url, regexp_replace({HOST}, '^www\\.', '') AS h, regexp_replace(regexp_replace({PATH}, ';[^/]*$', ''), '/+$', '') AS pa,
    list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND split_part(x, '=', 1) NOT IN ({TRACK})) AS q,
    lower(regexp_extract(url, '^([a-z][a-z0-9+.-]*)://', 1)) AS s FROM pages),
    o AS (SELECT page_id, unnest(q) AS kv, generate_subscripts(q, 1) AS i FROM p),
    f AS (SELECT *, min(i) OVER (PARTITION BY page_id, split_part(kv, '=', 1)) AS fi FROM o),
    j AS (SELECT page_id, string_agg(kv, '&' ORDER BY fi, i) AS qs FROM f GROUP BY page_id)
    SELECT page_id, CASE WHEN s = '' THEN url ELSE s || '://' || h || pa || CASE WHEN qs IS NOT NULL THEN '?' || qs ELSE '' END END AS normalized FROM p LEFT JOIN j USING (page_id)"""


@query(QUERY_NORMALIZE)
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, {HOST} AS domain FROM pages")
def url_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, regexp_replace(regexp_replace(lower(trim({HOST})), '\\.+$', ''), '^www\\.', '') AS host FROM pages")
def canonical_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical_host(U.domain(F.col("url"))).alias("host"))


#: Rules of the three kinds, in the list's form.
RULES = ("// rules", "com", "org", "net", "*.example.net", "!blog.example.net", "co.uk", "*.blog.example.com")


@query(
    f"""WITH p AS (SELECT page_id, url, regexp_replace({HOST}, '^www\\.', '') AS h FROM pages), l AS (SELECT *, string_split(h, '.') AS w FROM p), r(ending, kind) AS (VALUES ('com', 0), ('org', 0), ('net', 0), ('example.net', 1), ('blog.example.net', 2), ('co.uk', 0), ('blog.example.com', 1)),
e AS (SELECT page_id, h, len(w) AS n, unnest(range(1, len(w) + 1)) AS k, w FROM l), f AS (SELECT page_id, n, kind = 2 AS x, CASE kind WHEN 0 THEN k WHEN 1 THEN CASE WHEN n > k THEN k + 1 END ELSE k - 1 END AS s FROM e JOIN r ON ending = array_to_string(w[n - k + 1:], '.')),
b AS (SELECT page_id, arg_max(s, (x, s)) AS s FROM f WHERE s IS NOT NULL GROUP BY page_id)
SELECT page_id, CASE WHEN s IS NULL OR s >= len(w) THEN h ELSE array_to_string(w[len(w) - s:], '.') END AS registrable FROM l LEFT JOIN b USING (page_id)"""
)
def registrable_rules(spark, sf):
    """Each page's registrable domain by a table of suffix rules with wildcards and exceptions."""
    rules = suffixes.parsed(spark.createDataFrame([(r,) for r in RULES], "line string"))
    p = table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("h"))
    return suffixes.registrable(p, "h", rules).select("page_id", "registrable")


@query(f"WITH p AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, {REG} AS registrable FROM p")
def registrable_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.registrable_domain(U.domain(F.col("url"))).alias("registrable"))


@query("SELECT page_id, url FROM pages WHERE url GLOB '*example*/en/*' OR url GLOB '*.html'")
def url_glob(spark, sf):
    return table(spark, sf, "pages").where(U.url_matches(F.col("url"), ["*example*/en/*", "*.html"])).select("page_id", "url")


_TYPES = """WHEN ct = 'application/pdf' OR su = 'pdf' THEN 'pdf'
 WHEN ct = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' OR su = 'docx' THEN 'docx'
 WHEN ct = 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' OR su = 'xlsx' THEN 'xlsx'
 WHEN ct = 'application/vnd.openxmlformats-officedocument.presentationml.presentation' OR su = 'pptx' THEN 'pptx'
 WHEN ct IN ('text/html', 'application/xhtml+xml') OR su IN ('html', 'htm', 'xhtml') THEN 'html'
 WHEN ct IN ('text/markdown', 'text/x-markdown') OR su = 'md' THEN 'markdown' WHEN ct = 'application/json' OR su = 'json' THEN 'json'
 WHEN ct IN ('application/yaml', 'application/x-yaml', 'text/yaml', 'text/x-yaml') OR su IN ('yaml', 'yml') THEN 'yaml'
 WHEN ct IN ('application/xml', 'text/xml') OR su IN ('xml', 'rss', 'atom') THEN 'xml'
 WHEN ct IN ('text/csv', 'application/csv', 'application/vnd.ms-excel') OR su = 'csv' THEN 'csv' WHEN starts_with(ct, 'text/') THEN 'text'
 WHEN su IN ('bat', 'c', 'css', 'etx', 'h', 'js', 'ksh', 'markdown', 'mjs', 'n3', 'pl', 'py', 'rst', 'rtf', 'rtx', 'sgm', 'sgml', 'srt', 'tsv', 'txt', 'vcf', 'vtt') THEN 'text'"""
_CT = "CASE page_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' WHEN 3 THEN ' ' ELSE NULL END"


def _content_type():
    k = F.col("page_id") % 5
    return F.when(k == 0, "Text/HTML; charset=utf-8").when(k == 1, "application/pdf").when(k == 2, "text/plain").when(k == 3, " ")


@query(f"WITH p AS (SELECT page_id, nullif(lower(trim(split_part({_CT}, ';', 1))), '') AS ct, lower(regexp_extract({PATH}, '\\.([^.]*)$', 1)) AS su FROM pages) SELECT page_id, CASE {_TYPES} ELSE 'unknown' END AS file_type FROM p")
def file_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.file_type(F.col("url"), _content_type()).alias("file_type"))


@query(f"SELECT page_id, nullif(lower(trim(split_part({_CT}, ';', 1))), '') AS mime FROM pages")
def mime_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.mime(_content_type()).alias("mime"))


_IP = "(c_custkey * 7919 % 256)::VARCHAR || '.' || (c_custkey * 31 % 256)::VARCHAR || '.' || (c_custkey % 256)::VARCHAR || '.1'"
_RANGES = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in ((0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4026531839), (4026531840, 4294967295)))


@query(f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'localhost' ELSE {_IP} END AS host FROM customer), n AS (SELECT *, CASE WHEN host <> 'localhost' THEN split_part(host, '.', 1)::BIGINT * 16777216 + split_part(host, '.', 2)::BIGINT * 65536 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS n FROM c) SELECT c_custkey, host, host = 'localhost' OR coalesce({_RANGES}, false) AS blocked FROM n")
def ip_blocked(spark, sf):
    k = F.col("c_custkey")
    host = F.when(k % 50 == 0, "localhost").otherwise(F.concat((k * 7919 % 256).cast("string"), F.lit("."), (k * 31 % 256).cast("string"), F.lit("."), (k % 256).cast("string"), F.lit(".1")))
    return table(spark, sf, "customer").select("c_custkey", host.alias("host")).withColumn("blocked", U.ip_blocked(F.col("host")))




@query(f"WITH p AS (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS h FROM pages) SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS by_domain, h = 'example' OR ends_with(h, '.example') OR {REG} = 'example' AS by_name FROM p")
def domain_match(spark, sf):
    h = U.domain(F.col("url"))
    return table(spark, sf, "pages").select("page_id", U.matches(h, "example.com").alias("by_domain"), U.matches(h, "example").alias("by_name"))


def _patterns(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "pattern string")


def _suffixes(df):
    labels = F.split("h", r"\.")
    return df.withColumn("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))


@query(f"WITH p AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, h FROM p WHERE h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.net' OR ends_with(h, '.example.net')")
def domain_include(spark, sf):
    """Hosts' parent domains are joined with the patterns by hash, so no nested loop is planned."""
    p = table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("h"))
    return _suffixes(p).join(_patterns(spark, "example.org", "example.net"), "pattern", "left_semi").select("page_id", "h").distinct()


@query(f"WITH p AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, h FROM p WHERE NOT (h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.net' OR ends_with(h, '.example.net'))")
def domain_exclude(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("h"))
    bad = _suffixes(p).join(_patterns(spark, "example.org", "example.net"), "pattern", "left_semi").select("page_id")
    return p.join(bad, "page_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def language_filter(spark, sf):
    lang = T.coerce_optional(F.lit(" 'de' "))
    return table(spark, sf, "documents").where(lang.isNull() | (F.col("lang") == lang)).select("doc_id")


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({TITLE})), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')) AS title FROM pages")
def title_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_title(T.html_title(F.col("html"))).alias("title"))


@query(f"SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE {TITLE} END, 'untitled') AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.when(F.col("page_id") % 3 != 0, T.html_title(F.col("html"))), F.lit("untitled")).alias("title"))


def page_edges(pages):
    """(page_id, pos, url, href, label) of all links with their text, however the anchor is written."""
    return pages.select("page_id", "url", F.posexplode(T.anchors(F.col("html"))).alias("pos", "l")).select("page_id", "pos", "url", "l.href", "l.label")


_A = "(?is)<a\\b([^>]*)>(.*?)</a>"
_HREF = "(?i)(?:^|[\\s\"''])href\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
LINKS = f"""la AS (SELECT page_id, url, list_filter(list_transform(list_zip(regexp_extract_all(html, '{_A}', 1), regexp_extract_all(html, '{_A}', 2)), lambda x: {{'ok': regexp_matches(x[1], '{_HREF}'),
 'href': regexp_extract(x[1], '{_HREF}', 1) || regexp_extract(x[1], '{_HREF}', 2) || regexp_extract(x[1], '{_HREF}', 3), 'label': regexp_replace(x[2], '<[^>]*>', '', 'g')}}), lambda x: x.ok) AS f FROM pages),
l AS (SELECT page_id, url, o.href AS href, o.label AS label, pos FROM (SELECT page_id, url, unnest(f) AS o, unnest(range(0, len(f))) AS pos FROM la)),
r AS (SELECT page_id, pos::INT AS pos, url, label, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+)', 1) || ':' || href
 WHEN starts_with(href, '/') THEN {_ROOT} || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
 ELSE {_ROOT} || coalesce(nullif(regexp_replace({PATH}, '[^/]*$', ''), ''), '/') || href END AS target FROM l)"""


@query(f"WITH {LINKS} SELECT page_id, pos, target, CASE WHEN lower(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1)) = lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) THEN 'internal' ELSE 'external' END AS link_type FROM r WHERE regexp_matches(target, '^https?://[^/?#]+')")
def page_links(spark, sf):
    e = page_edges(table(spark, sf, "pages")).withColumn("target", U.resolve(F.col("url"), F.col("href"))).where("target is not null")
    same = F.lower(U.part(F.col("target"), 2)) == F.lower(U.part(F.col("url"), 2))
    return e.select("page_id", "pos", "target", F.when(same, "internal").otherwise("external").alias("link_type"))


_A11 = "'skip to main content', 'skip to content', 'skip to main', 'skip navigation', 'skip to navigation', 'jump to content', 'jump to main content', 'jump to navigation', 'main content'"


@query(f"WITH {LINKS} SELECT page_id, pos, CASE WHEN trim(label) = '' OR lower(trim(label)) IN ({_A11}) THEN NULL ELSE trim(label) END AS label FROM r")
def link_label(spark, sf):
    return page_edges(table(spark, sf, "pages")).select("page_id", "pos", U.link_label(F.col("label")).alias("label"))


_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(list_distinct({_W}))::INT AS n, array_to_string(list_sort(list_distinct({_W})), ' ') AS words FROM documents")
def word_set(spark, sf):
    return table(spark, sf, "documents").withColumn("w", T.word_set(F.col("text"))).select("doc_id", F.size("w").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


_WC = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \\t\\r\\n\\f\\x0B]+'), lambda x: x <> ''))::BIGINT"


@query(f"SELECT doc_id, {_WC.format('text')} AS words, length(text)::BIGINT AS chars FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


_RAW = "CASE event_id % 5 WHEN 0 THEN ' \"' || event_type || '\" ' WHEN 1 THEN 'NULL' WHEN 2 THEN '''none''' WHEN 3 THEN '  ' ELSE event_type END"


@query(f"WITH e AS (SELECT event_id, trim(trim(trim(trim({_RAW}), '\"'), '''')) AS t FROM events) SELECT event_id, CASE WHEN lower(t) IN ('', 'null', 'none') THEN NULL ELSE t END AS value FROM e")
def coerce_optional(spark, sf):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(' "'), "event_type", F.lit('" '))).when(k == 1, "NULL").when(k == 2, "'none'").when(k == 3, "  ").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", T.coerce_optional(raw).alias("value"))


@query("SELECT event_id, sha256('[\"' || lower(trim(event_type)) || '\",5,null,\"en\",' || (event_id % 3)::VARCHAR || ']') AS key FROM events")
def search_cache_key(spark, sf):
    parts = F.concat(F.lit('["'), F.lower(F.trim("event_type")), F.lit('",5,null,"en",'), (F.col("event_id") % 3).cast("string"), F.lit("]"))
    return table(spark, sf, "events").select("event_id", F.sha2(parts, 256).alias("key"))


_TAB = "CASE doc_id % 3 WHEN 0 THEN 'a | b\n|---|:--:|\n' || text ELSE text || '\n---\n' END"
_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"


@query(f"WITH d AS (SELECT doc_id, {_TAB} AS t FROM documents) SELECT doc_id, sha256(CASE WHEN contains(t, '|') AND contains(t, '---') THEN array_to_string(list_filter(string_split(t, '\n'), lambda x: NOT regexp_matches(x, '{_RULE}')), '\n') ELSE t END) AS stripped FROM d")
def strip_table_rows(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a | b\n|---|:--:|\n"), "text")).otherwise(F.concat("text", F.lit("\n---\n")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.strip_table_rows(t), 256).alias("stripped"))


_SOUP = "CASE WHEN doc_id % 2 = 0 THEN repeat('[' || lang || '](/' || source || ') ', 3 + (doc_id % 3)::INT) ELSE '[a](b) ' || text END"


@query(f"WITH d AS (SELECT doc_id, {_SOUP} AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '\\[[^\\]]*\\]\\([^)]*\\)')) >= 4 AND length(regexp_replace(regexp_replace(t, '\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '[`*_\\s]', '', 'g')) <= 12 AS soup FROM d")
def link_soup_lines(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.expr("repeat(concat('[', lang, '](/', source, ') '), cast(3 + doc_id % 3 as int))")).otherwise(F.concat(F.lit("[a](b) "), "text"))
    return table(spark, sf, "documents").select("doc_id", T.is_link_soup(t).alias("soup"))


_MD = "'Head[¶](#h)  \n\n\n\n' || repeat('[x](y) ', 5) || '\n\n\n' || text || '\n\n'"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace({_MD}, '\\[¶\\]\\([^)]*\\)', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, '\n'), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: NOT (len(regexp_extract_all(x, '\\[[^\\]]*\\]\\([^)]*\\)')) >= 4 AND length(regexp_replace(regexp_replace(x, '\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '[`*_\\s]', '', 'g')) <= 12)), '\n') AS t FROM d)
SELECT doc_id, sha256(trim(regexp_replace(t, '\n{{3,}}', '\n\n', 'g'), '\n')) AS cleaned FROM l""")
def clean_markdown(spark, sf):
    t = F.concat(F.lit("Head[¶](#h)  \n\n\n\n" + "[x](y) " * 5 + "\n\n\n"), "text", F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.clean_markdown(t), 256).alias("cleaned"))


_WALL = "CASE WHEN doc_id % 4 = 0 THEN 'Sign in or login. Forgot your password? Email or phone. ' || text ELSE text END"
_LOGIN = r"(?i)\b(log\s?in|sign\s?in|sign\s?up|forgot\s+(?:your\s+)?(?:password|account)|create\s+(?:new\s+)?account|email\s+or\s+phone(?:\s+number)?)\b"
_IS_WALL = _WC.format("t") + " < 400 AND len(regexp_extract_all(t, '" + _LOGIN + "')) >= 3"


def _walled():
    return F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Sign in or login. Forgot your password? Email or phone. "), "text")).otherwise(F.col("text"))


@query(f"WITH d AS (SELECT doc_id, {_WALL} AS t FROM documents) SELECT doc_id, {_IS_WALL} AS wall FROM d")
def login_wall(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.login_wall(_walled()).alias("wall"))


@query(f"WITH d AS (SELECT doc_id, {_WALL} AS t FROM documents) SELECT doc_id, {_WC.format('t')} >= 20 AND NOT ({_IS_WALL}) AS admitted FROM d")
def admission_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.admitted(_walled()).isNotNull().alias("admitted"))


@query(f"SELECT page_id, {TEXT} AS content FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("content"))


_B = "list_filter(list_transform(string_split(text, '\n'), lambda b: trim(b)), lambda b: b <> '')"


@query(f"SELECT doc_id, unnest(range(0, len(b)))::INT AS chunk_id, unnest(b) AS chunk FROM (SELECT doc_id, {_B} AS b FROM documents)")
def chunk_blocks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.blocks(F.col("text"), "\n")).alias("chunk_id", "chunk"))


def _packed_sql(pieces: str) -> str:
    """Neighbouring pieces of a list joined while they are 1000 characters together."""
    return f"list_reduce(list_transform({pieces}, lambda p: [p]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) > 1000 THEN a || x ELSE list_slice(a, 1, len(a) - 1) || [a[-1] || x[1]] END)"


def chunks_sql(source: str, key: str, text: str, name: str = "rc") -> str:
    """CTEs that end in ``name`` (key, b: chunks): paragraphs, then one level for each mark over pieces that are too long."""
    marks = ["\\n#{1,6} ", "```\\n", "\\n\\*\\*\\*+\\n", "\\n---+\\n", "\\n___+\\n", "\\n", " "]
    bare = "regexp_replace({0}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
    level = f"{name}0 AS (SELECT {key}, list_filter(list_transform(string_split(replace({text}, chr(31), ' '), E'\\n\\n'), lambda t: {bare.format('t')}), lambda t: t <> '') AS b FROM {source})"
    for k, mark in enumerate(marks):
        pieces = f"list_filter(string_split(regexp_replace(t, '({mark})', chr(31) || '\\1', 'g'), chr(31)), lambda p: p <> '')"
        level += f",\n{name}{k + 1} AS (SELECT {key}, flatten(list_transform(b, lambda t: CASE WHEN length(t) > 1000 THEN {_packed_sql(pieces)} ELSE [t] END)) AS b FROM {name}{k})"
    cut = "list_transform(range(0, ((length(t) + 999) // 1000)::BIGINT), lambda i: substr(t, i * 1000 + 1, 1000))"
    return level + f",\n{name} AS (SELECT {key}, list_filter(list_transform(flatten(list_transform(b, lambda t: {cut})), lambda t: {bare.format('t')}), lambda t: t <> '') AS b FROM {name}{len(marks)})"


@query(f"WITH {chunks_sql('documents', 'doc_id', 'text')} SELECT doc_id, unnest(range(0, len(b)))::INT AS chunk_id, unnest(b) AS chunk FROM rc")
def chunk_recursive(spark, sf):
    """All documents in chunks of at most 1000 characters, by the marks of markdown from coarse to fine."""
    return recursive_rows(table(spark, sf, "documents").select("doc_id", "text"), "text")


def recursive_rows(df, text):
    """``df`` without ``text``, a row for each chunk of it. The outer form, as the plain one works its array out once more to filter empty ones."""
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode_outer(recursive_chunks(text)).alias("chunk_id", "chunk"))
    return rows.where("chunk_id is not null")


@query(f"SELECT doc_id, i::INT AS chunk_id, b[i + 1] AS chunk FROM (SELECT doc_id, {_B} AS b, unnest([0, 2, 5]) AS i FROM documents) WHERE i < len(b)")
def chunk_select(spark, sf):
    return chunk_blocks(spark, sf).where(F.col("chunk_id").isin(5, 0, 2, 2))


@query(f"SELECT doc_id, array_to_string(list_slice({_B}, 1, 3), '\n\n[…]\n\n') AS head FROM documents")
def doc_head(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(T.blocks(F.col("text"), "\n"), 1, 3), T.GAP).alias("head"))


@query("""WITH d AS (SELECT DISTINCT user_id, (event_id % 40)::INT AS n FROM events), i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM d),
r AS (SELECT user_id, min(n) AS a, max(n) AS b FROM i GROUP BY user_id, g) SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '..' || b::VARCHAR END, ', ' ORDER BY a) AS spans FROM r GROUP BY user_id""")
def chunk_range(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "events").select("user_id", (F.col("event_id") % 40).cast("int").alias("n")).distinct()
    i = d.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy("user_id").orderBy("n")))
    r = i.groupBy("user_id", "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    span = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit(".."), F.col("b").cast("string")))
    return r.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", span.alias("s")))), lambda x: x["s"]), ", ").alias("spans"))
