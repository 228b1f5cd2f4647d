"""The main content of a page by the density of its blocks, in place of a plain strip of tags.

A page is cut at its block-level tags. A block scores by its length (logarithm), the share of it that isn't
links, and a weight of its tag; names of boilerplate in its class, id or role make the weight negative, and what lies in
navigation, asides, footers, forms and menus scores nothing. Scores are smoothed over neighbours with text, so a short
paragraph between long ones stays and a stray line between links goes; blocks from ``LEAST`` on are the content. All of
it is expressions over one row's arrays: nothing is shuffled and no Python runs.

Defined cases: null pages have no blocks and null content, pages without a block over the bar have empty content;
unclosed paragraphs end at the next block, a container that isn't closed holds the rest of the page, closing tags that nothing opened are ignored.
Comments that aren't closed are text. U+001F counts as a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "\x1f"
#: What is no text, with all inside it.
GONE = (r"(?s)<!--.*?-->", r"(?is)<head\b[^>]*>.*?</head>", r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?is)<noscript\b[^>]*>.*?</noscript>", r"(?is)<template\b[^>]*>.*?</template>")
BLOCK = r"(?i)(</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>)"
#: Containers of boilerplate.
OUTSIDE = ("nav", "aside", "footer", "form", "menu")
#: Weights by tag; others have OTHER.
WEIGHTS = {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "td": 0.8, "article": 0.8, "main": 0.8, "section": 0.8, "div": 0.8, "dd": 0.8, "h1": 0.6, "h2": 0.6, "h3": 0.6, "h4": 0.6, "h5": 0.6, "h6": 0.6, "li": 0.6, "th": 0.6, "dt": 0.6}
OTHER, BAD, GOOD, LEAST = 0.5, -1.0, 0.2, 1.5
_NAMED = r"(?i)\b(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:{})\b"
BAD_NAMES = _NAMED.format("ad|ads|advert|banner|breadcrumb|comment|cookie|footer|menu|nav|navigation|popup|promo|related|share|sidebar|social|sponsor|subscribe")
GOOD_NAMES = _NAMED.format("article|body|content|entry|main|post|story|text")
# The entities that are decoded, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """Text of a piece without block tags: breaks and white space are spaces, other tags go, common entities are decoded."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<(br|hr)\b[^>]*>", " "), r"<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


def with_blocks(df: DataFrame, html: str, name: str = "blocks") -> DataFrame:
    """``df`` with an array of the page's blocks with text: i (place), tag, text, links (share), raw and score."""
    body = F.replace(html, F.lit(CUT), F.lit(" "))
    for gone in GONE:
        body = F.regexp_replace(body, gone, " ")
    pieces = F.split(F.regexp_replace(body, BLOCK, CUT + "$1"), CUT)
    df = df.withColumn("_p", F.transform(pieces, lambda p, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(p, r"^<(/?[a-zA-Z0-9]+)", 1)).alias("tag"), p.alias("html"))))
    turn = lambda tag: F.when(tag.isin(*OUTSIDE), 1).when(tag.isin(*[f"/{t}" for t in OUTSIDE]), -1).otherwise(0)
    # how deep in containers each piece is
    empty = F.array().cast("array<int>")
    deep = F.aggregate("_p", empty, lambda a, p: F.array_append(a, F.greatest(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + turn(p["tag"]), F.lit(0))))
    df = df.withColumn("_d", deep)
    links = lambda p: F.aggregate(F.regexp_extract_all(p["html"], F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, a: n + F.length(plain(a)))
    # zipped: an array that a lambda looks into would be made anew for each element
    text = F.filter(F.zip_with("_p", "_d", lambda p, d: F.struct(p["i"].alias("i"), p["tag"].alias("tag"), plain(p["html"]).alias("text"), links(p).alias("linked"), F.regexp_extract(p["html"], r"^<[^>]*>", 0).alias("open"), d.alias("deep"))), lambda b: b["text"] != "")
    df = df.withColumn("_t", text)
    tags = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])
    weight = lambda b: F.when(b["open"].rlike(BAD_NAMES), BAD).otherwise(F.coalesce(F.try_element_at(tags, b["tag"]), F.lit(OTHER)) + F.when(b["open"].rlike(GOOD_NAMES), GOOD).otherwise(0.0))
    share = lambda b: F.least(b["linked"] / F.length(b["text"]), F.lit(1.0))
    raw = lambda b: F.when(b["deep"] > 0, 0.0).otherwise(weight(b) * (1 - share(b)) * F.log(1 + F.length(b["text"])))
    df = df.withColumn("_r", F.transform("_t", lambda b: F.struct(b["i"].alias("i"), b["tag"].alias("tag"), b["text"].alias("text"), F.round(share(b), 6).alias("links"), raw(b).alias("raw"))))
    near = F.transform("_r", lambda b: F.greatest(b["raw"], F.lit(0.0)))
    # the first and the last block are their own neighbours
    before, after = F.concat(F.slice(near, F.lit(1), F.lit(1)), near), F.concat(F.slice(near, F.lit(2), F.size(near)), F.slice(near, F.greatest(F.size(near), F.lit(1)), F.lit(1)))
    both = F.zip_with(before, after, lambda x, y: F.coalesce(x, F.lit(0.0)) * 0.25 + F.coalesce(y, F.lit(0.0)) * 0.25)
    scored = F.zip_with("_r", both, lambda b, n: F.struct(b["i"].alias("i"), b["tag"].alias("tag"), b["text"].alias("text"), b["links"].alias("links"), F.round(b["raw"], 6).alias("raw"), F.round(0.5 * b["raw"] + n, 6).alias("score")))
    return df.withColumn(name, F.slice(scored, F.lit(1), F.size("_r"))).drop("_p", "_d", "_t", "_r")


def kept(block: Column) -> Column:
    return (block["raw"] > 0) & (block["score"] >= LEAST)


def markdown(blocks: Column | str) -> Column:
    """The content blocks in order, headings and list items marked, a blank line between."""
    mark = lambda b: F.when(b["tag"].rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int")), F.lit(" "))).when(b["tag"] == "li", "- ").otherwise("")
    return F.array_join(F.transform(F.filter(blocks, kept), lambda b: F.concat(mark(b), b["text"])), "\n\n")
