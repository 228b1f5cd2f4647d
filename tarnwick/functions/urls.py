"""URL, host and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?is)^([a-z][a-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# Query keys that only track where a visit came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
# Public suffixes of one label.
ONE_LEVEL = tuple(
    "com org net edu gov mil int info biz name io dev app ai co me tv cc xyz online site tech blog cloud news page wiki eu "
    "ac ar at au be bg br ca ch cl cn cz de dk ee es fi fr gr hk hr hu id ie il in is it jp ke kr li lt lu lv mx my ng nl no nz pe ph pk pl pt ro rs ru "
    "sa se sg si sk th tr tw ua uk us ve vn za".split()
)
# Public suffixes of two labels that are common.
TWO_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx", "com.cn", "com.tr", "co.kr")
# Link texts that name a shortcut of the page and not where the link leads.
A11Y = (
    "skip to main content",
    "skip to content",
    "skip to main",
    "skip navigation",
    "skip to navigation",
    "jump to content",
    "jump to main content",
    "jump to navigation",
    "main content",
)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def authority_host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:@]*)", 1))


def domain(url: Column) -> Column:
    return F.coalesce(authority_host(url), F.lit(""))


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), r"^www\.", "")


def registrable_domain(host: Column, two_level: tuple[str, ...] = TWO_LEVEL, one_level: tuple[str, ...] = ONE_LEVEL) -> Column:
    """The public suffix and one label more; hosts without a known suffix, or that are one, stay."""
    two = F.substring_index(host, ".", -2)
    known = two.isin(*two_level) | F.substring_index(host, ".", -1).isin(*one_level)
    return F.when(~known | host.rlike(r"^[0-9.]+$"), host).when(two.isin(*two_level), F.substring_index(host, ".", -3)).otherwise(two)


def normalize(url: Column) -> Column:
    """One spelling for urls of the same page: host without www, port and user; no trailing slashes,
    path parameters, fragments, blank or tracking query values; repeated keys meet at their first."""
    host = F.regexp_replace(authority_host(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*$", ""), r"/+$", "")
    pairs = F.filter(F.split(F.coalesce(part(url, 4), F.lit("")), "&"), lambda p: p.rlike(r"^[^=]+=.") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == k)))
    query = F.array_join(grouped, "&")
    return F.when(part(url, 1) == "", url).otherwise(F.concat(F.lower(part(url, 1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def matches(host: Column, pattern: Column | str) -> Column:
    """A host is the pattern, under it, or registered as a pattern of one label."""
    p, h = canonical_host(F.lit(pattern) if isinstance(pattern, str) else pattern), canonical_host(host)
    return (h == p) | F.endswith(h, F.concat(F.lit("."), p)) | (~F.contains(p, F.lit(".")) & (registrable_domain(h) == p))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; ``*`` crosses slashes."""
    import re

    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i:end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def url_matches(url: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | url.rlike(glob_regex(g))
    return hit


# File types by mime type and by suffix, in order of trial.
TYPES = (
    ("pdf", ("application/pdf",), ("pdf",)),
    ("docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), ("docx",)),
    ("xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), ("xlsx",)),
    ("pptx", ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), ("pptx",)),
    ("html", ("text/html", "application/xhtml+xml"), ("html", "htm", "xhtml")),
    ("markdown", ("text/markdown", "text/x-markdown"), ("md",)),
    ("json", ("application/json",), ("json",)),
    ("yaml", ("application/yaml", "application/x-yaml", "text/yaml", "text/x-yaml"), ("yaml", "yml")),
    ("xml", ("application/xml", "text/xml"), ("xml", "rss", "atom")),
    ("csv", ("text/csv", "application/csv", "application/vnd.ms-excel"), ("csv",)),
)
# Other suffixes whose registered type is text.
TEXT_SUFFIXES = ("bat", "c", "css", "etx", "h", "js", "ksh", "markdown", "mjs", "n3", "pl", "py", "rst", "rtf", "rtx", "sgm", "sgml", "srt", "tsv", "txt", "vcf", "vtt")


def mime(content_type: Column) -> Column:
    """The type without parameters, or null."""
    return F.nullif(F.lower(F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))


def suffix(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 3), r"\.([^.]*)$", 1))


_NAMES = [name for name, _, _ in TYPES]


def _places(column: int) -> Column:
    """Each mime type (1) or suffix (2) with the place of the first type that names it."""
    first: dict[str, int] = {}
    for place, kind in enumerate(TYPES):
        for word in kind[column]:
            first.setdefault(word, place)
    return F.create_map(*[F.lit(v) for pair in first.items() for v in pair])


def _typed(m: Column, s: Column) -> Column:
    """The type by mime and suffix: of the two types that these name the one that stands first."""
    place = F.least(F.try_element_at(_places(1), m), F.try_element_at(_places(2), s))
    return F.coalesce(F.get(F.array(*map(F.lit, _NAMES)), place), F.when(F.startswith(m, F.lit("text/")) | s.isin(*TEXT_SUFFIXES), "text"), F.lit("unknown"))


def file_type(url: Column, content_type: Column) -> Column:
    return _once(F.struct(mime(content_type).alias("m"), suffix(url).alias("s")), lambda x: _typed(x["m"], x["s"]))


def ip_number(ip: Column) -> Column:
    octets = [F.try_element_at(F.split(ip, r"\."), F.lit(i)).cast("long") for i in range(1, 5)]
    return octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]


# IPv4 ranges that are not globally reachable.
BLOCKED = ((0, 8), (167772160, 8), (1681915904, 10), (2130706432, 8), (2851995648, 16), (2886729728, 12), (3221225472, 24), (3221225984, 24), (3232235520, 16), (3323068416, 15), (3325256704, 24), (3405803776, 24), (3758096384, 4), (4026531840, 4))


def ip_blocked(host: Column) -> Column:
    """Local names and addresses that are not globally reachable; a trailing dot and brackets don't matter.

    Of IPv6 only 2000::/3 is global; of it go documentation, benchmarking, ORCHID and Teredo prefixes.
    IPv4 addresses mapped to IPv6 are judged as IPv4."""
    v4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
    reserved = r"^(2001:0?db8:|2001:0{0,4}:|2001::|2001:0?2:0{0,4}:|2001:00?[12][0-9a-f]:|2001:[12][0-9a-f]:|3fff:0?[0-9a-f]{1,3}:|2002:)"

    def judged(h: Column) -> Column:
        """A clean host: by its number as IPv4, else by its text."""
        return _once(F.when(h.rlike(v4), ip_number(h)), lambda n: F.when(n.isNotNull(), _any_of(n)).otherwise((h == "localhost") | F.endswith(h, F.lit(".localhost")) | (h.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$") & (~h.rlike(r"^[23][0-9a-f]{3}:") | h.rlike(reserved)))))

    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^\[|\]$", ""), r"^::ffff:(?=[0-9]+\.)", "")
    return _once(clean, judged)


def _any_of(n: Column) -> Column:
    ranges = F.array(*[F.struct(F.lit(base).cast("long").alias("lo"), F.lit(base + 2 ** (32 - bits) - 1).cast("long").alias("hi")) for base, bits in BLOCKED])
    return F.exists(ranges, lambda r: n.between(r["lo"], r["hi"]))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once and not at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def link_label(text: Column) -> Column:
    t = F.trim(text)
    return F.when((t == "") | F.lower(t).isin(*A11Y), None).otherwise(t)


def resolve(base: Column, href: Column) -> Column:
    """An absolute url from a page's url and a link; null unless http or https with a host."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    out = F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    return F.when(out.rlike(r"(?i)^https?://[^/?#]+"), out)


# File signatures, as hexadecimal beginnings.
SIGNATURES = (("25504446", "application/pdf"), ("504b0304", "application/zip"), ("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("47494638", "image/gif"), ("1f8b", "application/gzip"), ("7b5c727466", "text/rtf"))
SNIFFED = 8192


def sniffed(content: Column, status: Column) -> Column:
    """The type that the first bytes of a partial answer tell; null for whole answers and beyond ``SNIFFED`` bytes."""

    def told(x: Column) -> Column:
        out = None
        for mark, name in SIGNATURES:
            out = F.when(F.startswith(x["head"], F.lit(mark)), name) if out is None else out.when(F.startswith(x["head"], F.lit(mark)), name)
        return out.when(x["text"].rlike(r"^\s*<(!doctype html|html)"), "text/html").when(x["text"].rlike(r"^\s*<\?xml"), "text/xml").when(x["text"].rlike(r"^\s*[\[{]"), "application/json")

    first = F.struct(F.lower(F.hex(F.substring(content, 1, 16))).alias("head"), F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1")).alias("text"))
    return F.when((status == 206) & (F.octet_length(content) <= SNIFFED), _once(first, told))


def detected(url: Column, head: Column, content: Column, status: Column) -> Column:
    """The file type by the announced type, else by the suffix, else by the first bytes."""
    def judged(x: Column) -> Column:
        known = F.nullif(x["m"], F.lit("application/octet-stream"))
        by_suffix = _typed(F.lit(None).cast("string"), x["s"])
        return F.when(known.isNotNull(), _typed(known, x["s"])).when(by_suffix != "unknown", by_suffix).otherwise(_typed(sniffed(content, status), x["s"]))

    return _once(F.struct(mime(head).alias("m"), suffix(url).alias("s")), judged)


def scope_globs(root: str, same_domain: bool = True) -> list[str]:
    """The globs that hold a crawl to the registrable domain and the host of its first seed; driver side."""
    import re

    if not same_domain:
        return []
    host = (re.match(r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", root) or ["", ""])[1].lower()
    labels = host.split(".")
    two = ".".join(labels[-2:])
    base = host
    if two in TWO_LEVEL and len(labels) > 2:
        base = ".".join(labels[-3:])
    elif labels[-1] in ONE_LEVEL and len(labels) > 1 and two not in TWO_LEVEL:
        base = two
    return [f"{scheme}://{name}/*" for scheme in ("http", "https") for name in dict.fromkeys((base, f"*.{base}", host))]


def in_scope(url: Column, root: str, same_domain: bool = True, include: list[str] | None = None) -> Column:
    """Whether a crawl may follow a url: within the scope of the root and any of the include globs."""
    def fits(u: Column) -> Column:
        ok = F.lit(True)
        for globs in (scope_globs(root, same_domain), include or []):
            if globs:
                ok = ok & url_matches(u, globs)
        return ok

    return _once(url, fits)


def retryable(status: Column, error: Column) -> Column:
    """Failures that are worth another try: 5xx answers, broken transport and timeouts."""
    return F.when(status.isNotNull(), status >= 500).otherwise(F.coalesce(error.isin("transport", "timeout"), F.lit(False)))
