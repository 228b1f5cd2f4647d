"""URL, text, chunk and source functions on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.operators import dedup
from tarnwick.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Shop.example:8443/a/b//?utm_source=x&q=1&z=&q=2#frag", "https://shop.example/a/b?q=1&q=2"),
        ("http://user:pw@site.example/", "http://site.example"),
        ("http://site.example/x;v=1", "http://site.example/x"),
        ("https://site.example/x?b=2&a=1&b=3&ref=home", "https://site.example/x?b=2&b=3&a=1"),
        ("no url", "no url"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.col("u")), u=url) == want


def test_domains(spark):
    assert one(spark, U.registrable_domain(F.col("h")), h="a.b.shop.co.uk") == "shop.co.uk"
    assert one(spark, U.registrable_domain(F.col("h")), h="docs.site.org") == "site.org"
    assert one(spark, U.registrable_domain(F.col("h")), h="docs.site.example") == "docs.site.example"
    assert one(spark, U.registrable_domain(F.col("h")), h="co.uk") == "co.uk"
    assert one(spark, U.canonical_host(F.col("h")), h=" WWW.Site.Example. ") == "site.example"
    assert one(spark, U.matches(F.col("h"), "site"), h="docs.site") is True
    assert one(spark, U.matches(F.col("h"), "intranet"), h="www.intranet") is True
    assert one(spark, U.matches(F.col("h"), "site.example"), h="mysite.example") is False


@pytest.mark.parametrize(("host", "blocked"), [("10.1.2.3", True), ("192.168.0.9", True), ("8.8.8.8", False), ("localhost", True), ("a.localhost", True), ("site.example", False), ("172.32.0.1", False), ("169.254.1.1", True), ("127.0.0.1.", True), ("[::1]", True), ("fe80::1", True), ("2606:4700::1111", False), ("::ffff:10.0.0.1", True), ("2001:db8::5", True), ("::", True), ("999.1.1.1", False)])
def test_ip(spark, host, blocked):
    assert one(spark, U.ip_blocked(F.col("h")), h=host) is blocked


@pytest.mark.parametrize(("href", "want"), [("/x", "http://s.example/x"), ("y.html", "http://s.example/a/y.html"), ("//o.example/z", "http://o.example/z"), ("#top", "http://s.example/a/b#top"), ("mailto:a@b", None), ("https://o.example/q", "https://o.example/q")])
def test_resolve(spark, href, want):
    assert one(spark, U.resolve(F.lit("http://s.example/a/b"), F.col("h")), h=href) == want


def test_globs(spark):
    assert one(spark, U.url_matches(F.col("u"), ["*/docs/*.htm?"]), u="http://a/docs/b/c.html") is True
    assert one(spark, U.url_matches(F.col("u"), ["*/[!a-c]*"]), u="http://z/d") is True
    assert one(spark, U.url_matches(F.col("u"), ["x*"]), u="http://z/d") is False


def test_types(spark):
    assert one(spark, U.file_type(F.col("u"), F.lit(None).cast("string")), u="http://s/a.b/c.PDF?x=1") == "pdf"
    assert one(spark, U.file_type(F.col("u"), F.lit("text/html; charset=x")), u="http://s/") == "html"
    assert one(spark, U.file_type(F.col("u"), F.lit("image/png")), u="http://s/") == "unknown"
    assert one(spark, files.sniff(F.unhex(F.col("b"))), b="255044462D312E37") == "application/pdf"
    assert one(spark, files.retryable(F.col("s"), F.lit(None).cast("string")), s=503) is True


def test_text(spark):
    assert one(spark, T.normalize_title(F.col("t")), t="  The  BIG É-Story! ") == "the big story"
    assert one(spark, T.coerce_optional(F.col("t")), t=" \"'None'\" ") is None
    assert one(spark, T.coerce_optional(F.col("t")), t=' "week" ') == "week"
    assert one(spark, T.strip_table_rows(F.col("t")), t="a|b\n|---|---|\n1|2\n---") == "a|b\n1|2\n---"
    assert one(spark, T.clean_markdown(F.col("t")), t="x  \n\n\n\ny\n[a](b) [a](b) [a](b) [a](b)\n") == "x\n\ny"
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a="abcd", b="abxd") == 75.0
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a="abc", b="") == 0.0
    assert one(spark, T.login_wall(F.col("t")), t="Sign in. Login. Create new account.") is True


def test_anchors_of_all_spellings(spark):
    html = """<a href="/a">A</a> <A class=x HREF='/b?x=1'> <b>B</b>old </A><a href=/c>c</a><a name="n">no</a><a data-href="/d">no</a><a
    target="_blank"
    href = "/e"><img alt="<"></a><a href="">self</a><abbr href="/f">no</abbr><a href="/open">open"""
    df = spark.createDataFrame([(html,), (None,)], "h string")
    got = [r.a for r in df.select(T.anchors(F.col("h")).alias("a")).collect()]
    assert [(x.href, x.label.strip()) for x in got[0]] == [("/a", "A"), ("/b?x=1", "Bold"), ("/c", "c"), ("/e", ""), ("", "self")] and got[1] is None


def test_first_wins_is_sequential(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 7), (6, 7)]
    kept, gone = [], set()
    for i in range(1, 8):
        if any((a, i) in pairs for a in kept):
            gone.add(i)
        else:
            kept.append(i)
    got = dedup.first_wins(spark.createDataFrame(pairs, "a int, b int"))
    assert {r.id for r in got.collect()} == gone
    assert dedup.first_wins(spark.createDataFrame([], "a int, b int")).count() == 0


def test_bands_balance_around_the_threshold():
    b, r = dedup.bands(128, 0.75)
    assert b * r <= 128 and 0.6 < (1 / b) ** (1 / r) < 0.9


def test_crawl_stream(spark):
    lines = [("a", 0, ""), ("a", 1, "junk"), ("a", 2, '{"status":"ok","url":"u1"}'), ("a", 3, '{"status":"completed"}'), ("a", 4, '{"status":"ok","url":"late"}')]
    got = files.crawl_stream(spark.createDataFrame(lines, "stream string, line_no int, value string")).collect()
    assert [r.url for r in got] == ["u1"]
    bad = files.crawl_stream(spark.createDataFrame([("b", 0, '{"status":"failed","error":"x"}')], "stream string, line_no int, value string"))
    with pytest.raises(Exception, match="crawl failed"):
        bad.collect()


def test_similar_sets_and_first_wins_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = set(rng.choice(base))
        for w in rng.sample(sorted(words), rng.randrange(len(words) // 5 + 1)):
            words.discard(w)
            words.add(f"x{rng.randrange(300)}")
        rows.append((i, sorted(words)))
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(4)
    sets = {i: set(w) for i, w in rows}
    like = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in dedup.similar_sets(df, "id", "w", 0.75).collect()} == like and len(like) > 100
    kept: list[int] = []
    for i in sorted(sets):
        if not any((k, i) in like for k in kept):
            kept.append(i)
    assert {r.id for r in dedup.first_wins_sets(df, "id", "w", 0.75).collect()} == set(sets) - set(kept)
    assert dedup.first_wins_sets(df.limit(0), "id", "w", 0.75).count() == 0


@pytest.mark.parametrize("label", ["Skip to main content", " skip navigation ", "JUMP TO CONTENT", "main content", "  "])
def test_shortcut_labels_are_dropped(spark, label):
    assert one(spark, U.link_label(F.col("t")), t=label) is None


@pytest.mark.parametrize("label", ["menu", "Home", "search", "close", "Skip to main content guide"])
def test_other_labels_stay(spark, label):
    assert one(spark, U.link_label(F.col("t")), t=label) == label


@pytest.mark.parametrize("key", ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid"])
def test_tracking_keys_go(spark, key):
    assert one(spark, U.normalize(F.col("u")), u=f"https://a.example/p?{key}=1&utm_id=2") == "https://a.example/p?utm_id=2"


@pytest.mark.parametrize(("url", "mime", "want"), [("http://a/x.rss", None, "xml"), ("http://a/x.atom", None, "xml"), ("http://a/x", "text/x-yaml", "yaml"), ("http://a/x", "application/vnd.ms-excel", "csv"), ("http://a/x", "application/csv", "csv"), ("http://a/x.md", None, "markdown"), ("http://a/x.py", None, "text"), ("http://a/x", "text/plain", "text"), ("http://a/x.bin", "application/ld+json", "unknown")])
def test_file_types(spark, url, mime, want):
    assert one(spark, U.file_type(F.col("u"), F.lit(mime).cast("string")), u=url) == want


def test_detected_types(spark):
    kind = lambda u, head, first, status: one(spark, U.detected(F.col("u"), F.lit(head).cast("string"), F.unhex(F.col("b")), F.lit(status)), u=u, b=first)
    pdf = "255044462D312E37"
    assert kind("http://a/x", "application/pdf", "", 200) == "pdf"
    assert kind("http://a/x.docx", "application/octet-stream", pdf, 206) == "docx"
    assert kind("http://a/x", "application/octet-stream", pdf, 206) == "pdf"
    assert kind("http://a/x", None, pdf, 200) == "unknown"
    assert one(spark, U.sniffed(F.col("b").cast("binary"), F.lit(206)), b="x" * 9000) is None


def test_scope(spark):
    assert U.scope_globs("https://docs.service.example.co.uk/x")[0] == "http://example.co.uk/*"
    ok = lambda u, **k: one(spark, U.in_scope(F.col("u"), "https://docs.example.org/", **k), u=u)
    assert ok("http://example.org/a") and ok("https://b.example.org/a") and not ok("https://example.com/a")
    assert ok("https://example.com/a", same_domain=False) and not ok("https://b.example.org/a", include=["*/docs/*"])


def test_spans_and_meta_line(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, T.spans(ids(5, 30, 60)), u="") == "5, 30, 60"
    assert one(spark, T.spans(ids(2, 0, 1, 1, 7)), u="") == "0..2, 7"
    assert one(spark, T.spans(F.array().cast("array<int>")), u="") is None
    line = T.meta_line(F.lit("html"), F.lit("text/html"), ids(0, 1), F.lit(9), F.lit("relevant"), F.lit(1500), F.lit(24000))
    assert one(spark, line, u="") == "chunks: 0..1 of 0..8 | mode: relevant | 1,500 of 24,000 chars"


def test_citation(spark):
    page = '<head><meta content="D" name="description"><meta name="author" content="Ann"><meta property="article:published_time" content="2024-05-06T07:08"></head>'
    got = one(spark, T.html_citation(F.col("t")), t=page)
    assert (got.author, got.date, got.site_name, got.description) == ("Ann", "2024-05-06", None, "D")


def test_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(12)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(14)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(([], [t[k], "x"], ["y"]))
            t = t or ["z"]
        rows.append((i, f"h{i % 2}", "".join(t)))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    want = {(i, j) for i, g, t in rows for j, h, u in rows if i < j and g == h and 200 * lcs(t, u) / (len(t) + len(u)) >= 97}
    got = dedup.fuzzy_pairs(spark.createDataFrame([*rows, (500, "h0", ""), (501, "h0", "")], "k long, g string, t string"), "g", "k", "t")
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 40


def test_ranked_is_the_whole_order(spark):
    from tarnwick.operators import rank

    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.1, 0.5, rng.random()])) for i in range(700)]
    got = rank.ranked(spark.createDataFrame(rows, "i int, s double"), F.desc_nulls_last("s"), F.col("i")).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.i: r["rank"] for r in got} == {r[0]: k for k, r in enumerate(order, 1)}
