"""Text functions: titles, words, markdown cleaning, chunks, hashes and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_]+"
# The rule row of a table and a link, in markdown.
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
LINK = r"\[[^\]]*\]\([^)]*\)"
# Fixed value: phrases that cluster on login pages.
LOGIN = r"(?i)\b(log\s?in|sign\s?in|sign\s?up|forgot\s+(?:your\s+)?(?:password|account)|create\s+(?:new\s+)?account|email\s+or\s+phone(?:\s+number)?)\b"
GAP = "\n\n[…]\n\n"


def strip_tags(html: Column) -> Column:
    """Text of a page by rule: scripts, styles and comments go, tags become spaces, white space collapses."""
    body = html
    for gone in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        body = F.regexp_replace(body, gone, " ")
    return F.trim(F.regexp_replace(body, r"[ \t\r\n\f]+", " "))


ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF = r"(?i)(?:^|[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def anchors(html: Column) -> Column:
    """(href, label) of all anchors with an href, quoted in either way or not at all; tags inside a label go."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("attrs"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    href = lambda a: F.concat(*[F.regexp_extract(a, HREF, k) for k in (1, 2, 3)])
    return F.transform(F.filter(found, lambda x: x["attrs"].rlike(HREF)), lambda x: F.struct(href(x["attrs"]).alias("href"), F.regexp_replace(x["inner"], "<[^>]*>", "").alias("label")))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]+", ""), r" +", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), NON_WORD), ""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[ \t\r\n\f\x0B]+"), "")), F.lit(0)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def coerce_optional(raw: Column) -> Column:
    t = F.trim(F.btrim(F.btrim(F.trim(raw), F.lit('"')), F.lit("'")))
    return F.when(F.lower(t).isin("", "null", "none"), None).otherwise(t)


def strip_table_rows(text: Column) -> Column:
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(TABLE_RULE)), "\n")
    return F.when(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), kept).otherwise(text)


def is_link_soup(line: Column) -> Column:
    """At least four markdown links and next to nothing else."""
    rest = F.regexp_replace(F.regexp_replace(line, LINK, ""), r"[`*_\s]", "")
    return (F.regexp_count(line, F.lit(LINK)) >= 4) & (F.length(rest) <= 12)


def clean_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"\[¶\]\([^)]*\)", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: ~is_link_soup(x))
    return F.nullif(F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit("\n")), F.lit(""))


def best_markdown(extracted: Column, fit: Column, raw: Column, text: Column, cleaned: Column) -> Column:
    """The first usable form of a page: the extracted one if it isn't tiny, then the crawler's forms."""
    return F.coalesce(F.when(F.length(F.trim(extracted)) >= 50, extracted), *(F.nullif(x, F.lit("")) for x in (fit, raw, text, cleaned)))


def login_wall(text: Column) -> Column:
    return (word_count(text) < 400) & (F.regexp_count(text, F.lit(LOGIN)) >= 3)


def admitted(text: Column) -> Column:
    """The text if it is worth keeping, else null."""
    return F.when((word_count(text) >= 20) & ~login_wall(text), text)


def blocks(text: Column, by: str = "\n\n") -> Column:
    """Trimmed non-empty blocks."""
    return F.filter(F.transform(F.split(text, by), lambda b: F.trim(b)), lambda b: b != "")


def rank_band(rank: Column) -> Column:
    return F.when(rank == 1, "top match").when(rank <= 3, "strong match").otherwise("possible match")


# What is said of a warning of each type, before its detail and after it.
ISSUES = {
    "scrape_failed": ("partial scrape: ", " — snippet used instead"),
    "low_relevance_filtered": ("filtered low-relevance results: ", ""),
    "search_failed": ("search backend failed: ", ""),
    "rerank_failed": ("reranker failed: ", ""),
    "engine_unresponsive": ("upstream engine unavailable: ", ""),
}


def issue_line(kind: Column, detail: Column) -> Column:
    out = F.when(kind == "no_results", "no results found")
    for name, (before, after) in ISSUES.items():
        out = out.when(kind == name, F.concat(F.lit(before), detail, F.lit(after)))
    return out.otherwise(detail)


def issues_block(label: str, lines: Column) -> Column:
    """A label and a list of lines; null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{label}:\n- "), F.array_join(lines, "\n- ")))


def kv_block(*pairs: tuple[str, Column]) -> Column:
    """Lines ``key: value`` of what is neither null nor empty."""
    return F.concat_ws("\n", *[F.when(F.nullif(v, F.lit("")).isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])


def spans(ids: Column) -> Column:
    """Numbers as runs ``a..b`` and single ones, or null."""
    d = F.array_sort(F.array_distinct(ids))
    starts = F.filter(d, lambda x: ~F.array_contains(d, x - 1))
    ends = F.filter(d, lambda x: ~F.array_contains(d, x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit(".."), b.cast("string"))))
    return F.nullif(F.array_join(runs, ", "), F.lit(""))


def meta_line(file_type: Column, content_type: Column, shown_ids: Column, total_chunks: Column, mode: Column, chars_shown: Column, total_chars: Column) -> Column:
    """What a document section says of type, chunks, mode and length; null if nothing."""
    last = F.concat(F.lit("0.."), (total_chunks - 1).cast("string"))
    kind = F.when((file_type != "html") & (file_type != ""), F.concat(F.lit("type: "), file_type)).when((content_type != "text/html") & (content_type != ""), F.concat(F.lit("content_type: "), content_type))
    span = spans(shown_ids)
    chunks = F.when(total_chunks > 0, F.concat(F.lit("chunks: "), F.coalesce(F.concat(span, F.lit(" of "), last), last)))
    how = F.when(mode.isin("relevant", "document", "selected"), F.concat(F.lit("mode: "), mode))
    chars = F.when((total_chars > 0) & (chars_shown > 0), F.concat(F.format_number(chars_shown, 0), F.lit(" of "), F.format_number(total_chars, 0), F.lit(" chars")))
    return F.nullif(F.concat_ws(" | ", kind, chunks, how, chars), F.lit(""))


def tree_line(title: Column, link_text: Column, url: Column, depth: Column, link_type: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(link_text, F.lit("")), url)
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), name, F.lit("]("), url, F.lit(")"), F.when(link_type == "external", " (ext)").otherwise(""))


def document_section(title: Column, url: Column, status: Column, content: Column, error: Column, file_type: Column, handler: Column, reason: Column, meta: Column) -> Column:
    """One document as markdown: error, hand-off or content under its title; ``meta`` (or null) stands first."""
    head = F.concat(F.lit("## ["), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")), F.lit("]("), url, F.lit(")"))
    handed = F.concat(F.lit("**Handoff:** `"), F.coalesce(file_type, F.lit("file")), F.lit("` content should be handled by the `"), F.coalesce(handler, F.lit("files")), F.lit("` MCP.\n\n"), F.coalesce(reason, F.lit("delegated to another MCP")))
    body = F.when(status == "error", F.concat(F.lit("**Error:** "), F.coalesce(error, F.lit("extraction failed")))).when(status == "handoff", handed).otherwise(F.nullif(content, F.lit("")))
    return F.concat_ws("\n\n", head, F.concat(F.lit("_"), meta, F.lit("_")), body)


def search_section(title: Column, url: Column, rank: Column, domain: Column, date: Column, scraped: Column, content: Column) -> Column:
    """One search result as markdown."""
    text = F.nullif(content, F.lit(""))
    line = F.nullif(F.concat_ws(" | ", F.nullif(domain, F.lit("")), F.nullif(date, F.lit("")), rank_band(rank), F.when(~scraped & text.isNotNull(), "snippet only")), F.lit(""))
    head = F.concat(F.lit("## "), rank.cast("string"), F.lit(". ["), F.coalesce(title, F.lit("Untitled")), F.lit("]("), url, F.lit(")"))
    return F.concat_ws("\n\n", head, F.concat(F.lit("_"), line, F.lit("_")), text)


def html_meta(html: Column, *names: str) -> Column:
    """The content of the first meta element of one of these names or properties, in their order."""
    found = []
    for name in names:
        key = name.replace(".", r"\.")
        for rx in (rf"(?is)<meta[^>]*\b(?:name|property)\s*=\s*[\"']{key}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)", rf"(?is)<meta[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\b(?:name|property)\s*=\s*[\"']{key}[\"']"):
            found.append(F.nullif(F.trim(F.regexp_extract(html, rx, 1)), F.lit("")))
    return F.coalesce(*found)


def html_citation(html: Column) -> Column:
    """author, date, site_name and description as a page's head states them."""
    date = F.nullif(F.regexp_extract(F.coalesce(html_meta(html, "article:published_time", "date", "dc.date"), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.struct(html_meta(html, "author", "article:author", "dc.creator").alias("author"), date.alias("date"), html_meta(html, "og:site_name", "application-name").alias("site_name"), html_meta(html, "description", "og:description").alias("description"))


def preview(text: Column, limit: int = 120) -> Column:
    """A text on one line, cut with dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def header_value(markdown: Column, key: str) -> Column:
    """The value of a ``key: value`` line before the first rule, or null."""
    return F.nullif(F.regexp_extract(F.substring_index(markdown, "\n---", 1), rf"(?m)^{key}: (.*)$", 1), F.lit(""))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by dynamic programming in nested folds; no Python."""
    import_empty = F.array_repeat(F.lit(0), F.length(b))

    def row(o: Column, i: Column) -> Column:
        cell = lambda n, j: F.array_append(n, F.greatest(F.coalesce(F.try_element_at(n, F.lit(-1)), F.lit(0)), F.get(o, j - 1), F.when(j == 1, 0).otherwise(F.get(o, j - 2)) + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1)), 1).otherwise(0)))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array().cast("array<int>"), cell)

    full = F.array_max(F.aggregate(F.sequence(F.lit(1), F.length(a)), import_empty, row))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(full)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of 0 to 100 by insertions and deletions."""
    return F.lit(200.0) * lcs_length(a, b) / (F.length(a) + F.length(b))
