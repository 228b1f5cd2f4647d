"""Main content of pages: fixed layouts, a plain scorer, and the test tables' chrome."""

import math
import os
import re

import pytest

from tarnwick.functions import content as C
from tarnwick.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"
P = "A paragraph of some length that a reader came for, with words enough."


def extracted(spark, html):
    return C.with_blocks(spark.createDataFrame([(html,)], "h string"), "h").select(C.markdown("blocks")).first()[0]


def test_chrome_goes_and_text_stays(spark):
    html = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header class="site-menu">Home</header><nav><ul><li><a href="/a">One</a></li><li><p>{P}</p></li></ul></nav>
    <div class="ad">{P}</div><div id=sidebar>{P}</div><article><h2>The head</h2><p>{P}<p>Short.<p>{P} <b>bold</b>ly<ul><li>a point of the list that matters<li><a href="x">only a link here</a></ul><script>var x = "<p>{P}";</script></article>
    <!-- <p>{P}</p> --><form><p>{P}</p></form><footer><div><p>{P}</p></div></footer><aside>{P}</aside></body></html>"""
    got = extracted(spark, html)
    assert got == f"## The head\n\n{P}\n\nShort.\n\n{P} boldly\n\n- a point of the list that matters"


def test_link_lists_score_by_what_is_no_link(spark):
    linked = "".join(f'<p><a href="/{i}">{P}</a></p>' for i in range(4))
    assert extracted(spark, linked) == ""
    assert extracted(spark, f'<p>{P} <a href="/">see</a></p>' + linked) == f"{P} see"


@pytest.mark.parametrize("html", ["", "no tags but text that is long enough to be a page", f"</nav></footer><p>{P}", f"<nav><nav>x</nav>{P}</nav><p>{P}", f"<nav>{P}", "<p>", "&lt;p&gt; &amp;amp; " + P, "<br>" * 50 + P, f"<p class='x\">{P}", "\x1f" + P])
def test_torn_pages(spark, html):
    got = extracted(spark, html)
    assert (P in got) == (P in html and not html.startswith(f"<nav>{P}")) or html.startswith("<p class")
    assert got == html if "no tags" in html else True
    assert "\x1f" not in got and "&lt;" not in got


def test_null_page(spark):
    assert extracted(spark, None) is None


def plain_scores(html):
    """(tag, text, raw) of a page's blocks by a scan, without arrays."""
    for gone in C.GONE:
        html = re.sub(gone, " ", html)
    out, depth = [], 0
    for piece in re.sub(C.BLOCK, C.CUT + r"\1", html).split(C.CUT):
        tag = (re.match(r"<(/?[a-zA-Z0-9]+)", piece) or ["", ""])[1].lower()
        depth = max(depth + (tag in C.OUTSIDE) - (tag.lstrip("/") in C.OUTSIDE and tag.startswith("/")), 0)
        clean = lambda t: re.sub(r"[ \t\r\n\f]+", " ", re.sub(r"<[^>]*>", "", re.sub(r"(?i)<(br|hr)\b[^>]*>", " ", t)).replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">").replace("&nbsp;", " ").replace("&#39;", "'").replace("&copy;", "©").replace("&middot;", "·").replace("&amp;", "&")).strip(" ")
        text = clean(piece)
        if text:
            linked = sum(len(clean(a)) for a in re.findall(r"(?is)<a\b[^>]*>(.*?)</a>", piece))
            open_ = (re.match(r"<[^>]*>", piece) or [""])[0]
            w = -1.0 if re.search(C.BAD_NAMES, open_) else C.WEIGHTS.get(tag, 0.5) + 0.2 * bool(re.search(C.GOOD_NAMES, open_))
            out.append((tag, text, 0.0 if depth else w * (1 - min(linked / len(text), 1)) * math.log(1 + len(text))))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_blocks_equal_a_plain_scan_and_articles_are_kept(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {}
    for r in QUERIES["content_blocks"](spark, DATA).collect():
        got.setdefault(r.page_id, []).append(r)
    for page, html in pages.items():
        rows = sorted(got[page], key=lambda r: r.i)
        want = plain_scores(html)
        assert [(r.tag, r.text) for r in rows] == [w[:2] for w in want]
        raws = [w[2] for w in want]
        for k, r in enumerate(rows):
            score = 0.5 * raws[k] + 0.25 * max(raws[max(k - 1, 0)], 0) + 0.25 * max(raws[min(k + 1, len(raws) - 1)], 0)
            assert abs(r.raw - raws[k]) < 2e-6 and abs(r.score - score) < 2e-6
        article = re.search(r"(?s)<article>(.*?)</article>", html)[1]
        chrome = [r for r in rows if r.tag in ("li", "div", "footer")]
        assert chrome and not any(r.kept for r in chrome)
        kept = [r for r in rows if r.kept]
        assert sum(len(r.text) for r in kept) >= 0.98 * sum(len(r.text) for r in rows if r not in chrome), article[:200]
