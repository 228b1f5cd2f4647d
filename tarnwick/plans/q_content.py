"""Queries of main-content extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import content as C
from tarnwick.plans.base import query, table

# The SQL states its own values.
_GONE = "html"
for _tag in ("(?s)<!--.*?-->", *(f"(?is)<{t}\\b[^>]*>.*?</{t}>" for t in ("head", "script", "style", "noscript", "template"))):
    _GONE = f"regexp_replace({_GONE}, '{_tag}', ' ', 'g')"
_CUT = "(</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\\b[^>]*>)"
_PLAIN = "regexp_replace(regexp_replace({0}, '(?i)<(br|hr)\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_char}')"
_PLAIN = f"trim(regexp_replace({_PLAIN}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
_NAMES = "(?i)\\b(?:class|id|role)\\s*=\\s*[\"'']?[^\"''>]*\\b(?:{0})\\b"
_SCORED = f"""pc AS (SELECT page_id, string_split(regexp_replace({_GONE}, '(?i){_CUT}', chr(31) || '\\1', 'g'), chr(31)) AS p FROM pages),
pe AS (SELECT page_id, unnest(range(0, len(p)))::INT AS i, unnest(p) AS html FROM pc), tg AS (SELECT *, lower(regexp_extract(html, '^<(/?[a-zA-Z0-9]+)', 1)) AS tag, regexp_extract(html, '^<[^>]*>') AS o FROM pe),
st AS (SELECT *, sum(CASE WHEN tag IN ('nav', 'aside', 'footer', 'form', 'menu') THEN 1 WHEN tag IN ('/nav', '/aside', '/footer', '/form', '/menu') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM tg),
dp AS (SELECT *, d - least(min(d) OVER (PARTITION BY page_id ORDER BY i), 0) AS deep FROM st),
tx AS (SELECT * FROM (SELECT page_id, i, tag, o, deep, {_PLAIN.format("html")} AS text, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: length({_PLAIN.format("x")}))), 0) AS linked FROM dp) WHERE text <> ''),
sh AS (SELECT *, least(linked / length(text), 1.0::DOUBLE) AS links, CASE WHEN regexp_matches(o, '{_NAMES.format("ad|ads|advert|banner|breadcrumb|comment|cookie|footer|menu|nav|navigation|popup|promo|related|share|sidebar|social|sponsor|subscribe")}') THEN -1.0::DOUBLE
 ELSE (CASE WHEN tag IN ('p', 'pre', 'blockquote') THEN 1.0 WHEN tag IN ('td', 'article', 'main', 'section', 'div', 'dd') THEN 0.8 WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'th', 'dt') THEN 0.6 ELSE 0.5 END)::DOUBLE + CASE WHEN regexp_matches(o, '{_NAMES.format("article|body|content|entry|main|post|story|text")}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END END AS w FROM tx),
rw AS (SELECT page_id, i, tag, text, round(links, 6) AS links, CASE WHEN deep > 0 THEN 0.0::DOUBLE ELSE w * (1 - links) * ln(1 + length(text)) END AS raw FROM sh),
sc AS (SELECT *, round(0.5 * raw + 0.25 * greatest(coalesce(lag(raw) OVER (PARTITION BY page_id ORDER BY i), raw), 0.0::DOUBLE) + 0.25 * greatest(coalesce(lead(raw) OVER (PARTITION BY page_id ORDER BY i), raw), 0.0::DOUBLE), 6) AS score FROM rw)"""


@query(f"WITH {_SCORED} SELECT page_id, i, tag, text, links, round(raw, 6) AS raw, score, raw > 0 AND score >= 1.5 AS kept FROM sc")
def content_blocks(spark, sf):
    """Every block of every page with its score, and whether it is content."""
    p = C.with_blocks(table(spark, sf, "pages").select("page_id", "html"), "html")
    b = p.select("page_id", F.explode_outer("blocks").alias("b")).where("b is not null")
    return b.select("page_id", "b.i", "b.tag", "b.text", "b.links", "b.raw", "b.score", C.kept(F.col("b")).alias("kept"))


@query(f"WITH {_SCORED}, md AS (SELECT page_id, string_agg(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', substr(tag, 2, 1)::INT) || ' ' WHEN tag = 'li' THEN '- ' ELSE '' END || text, E'\\n\\n' ORDER BY i) AS content FROM sc WHERE raw > 0 AND score >= 1.5 GROUP BY page_id) SELECT page_id, coalesce(content, '') AS content FROM pages LEFT JOIN md USING (page_id)")
def main_content(spark, sf):
    """Each page's main content as markdown."""
    p = C.with_blocks(table(spark, sf, "pages").select("page_id", "html"), "html")
    return p.select("page_id", C.markdown("blocks").alias("content"))
