"""Nulls, repeated rows, long texts, empty tables and extra columns of clashing names, for each operator."""

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import decontam, html_layout, minhash, mixing, ring_shard, secrets, suffix_dedup, telephony, toxicity, url_cascade

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = [(1, "alpha beta " * 200, "en", "s1"), (1, "alpha beta " * 200, "en", "s1"), (2, None, "en", "s1"), (3, "", "en", None), (None, "password=abcdef0123456789abcd hello " * 5, None, "s2"), (None, None, None, None), (4, LONG, "en", "s2"), (5, "   \t\n ", "de", "s2"), (6, "é" * 300, "en", "s1")]
BENCH = [(1, "alpha beta " * 10), (2, None), (3, ""), (None, "gamma")]
LABELS = [(1, 1), (2, 0), (3, None), (None, 1)]
PAGES = [(1, "http://a.org/x", "<p>hi"), (1, "http://a.org/x", "<p>hi"), (2, None, None), (3, "nourl", ""), (None, "x://", "<table><tr><td>a<td>b"), (5, "http://" + "a." * 3000 + "com/fr/" + "y" * 5000, "<div>" * 3000 + "z")]
#: Names of results and of inner columns.
CLASHING = "n_words n_hit items spans hits shard slot size text_crc32 n_bytes kept n_shingles component_id score predicted n_tokens weight epoch place block tokens take host path rule verdict key term pos w row uid sk a b m sh start n win toxic word run payload pcm feature before coverage features probability".split()


def table(spark, rows, schema, empty):
    df = spark.createDataFrame(rows, schema)
    df = df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
    return df.limit(0) if empty else df


OPERATORS = {
    "decontamination": lambda d, b, y, p: decontam.contamination(d, b).select("doc_id", "n_words", "n_hit", "items"),
    "secrets": lambda d, b, y, p: secrets.scan_all(d, path_col="source"),
    "html": lambda d, b, y, p: html_layout.extract(p).select("page_id", "text"),
    "urls": lambda d, b, y, p: url_cascade.judge(p, ["org/"], ["com/fr/"]).select("page_id", "host", "path", "rule", "verdict"),
    "shards": lambda d, b, y, p: ring_shard.assign(ring_shard.measured(d)).select("doc_id", "size", "shard", "slot"),
    "suffixes": lambda d, b, y, p: suffix_dedup.remove_repeats(d).select("doc_id", "n_bytes", F.octet_length("kept").alias("left")),
    "mixing": lambda d, b, y, p: mixing.mix(d).select("doc_id", "source", "n_tokens", "epoch"),
    "telephony": lambda d, b, y, p: telephony.decode_media(telephony.encode_texts(d), keep_pcm=False).drop("pcm"),
    "minhash": lambda d, b, y, p: minhash.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "toxicity": lambda d, b, y, p: toxicity.score(d, toxicity.fit(d, y)).select("doc_id", "score", "predicted"),
}


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name, empty):
    docs = table(spark, DOCS, "doc_id long, text string, lang string, source string", empty)
    bench = table(spark, BENCH, "item_id long, text string", empty)
    labels = table(spark, LABELS, "doc_id long, toxic int", empty)
    pages = table(spark, PAGES, "page_id long, url string, html string", empty)
    rows = OPERATORS[name](docs, bench, labels, pages).collect()
    if empty:
        assert not rows
        return
    if name == "decontamination":
        hit = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows}
        assert len(rows) == 9 and (1, 400, 400, ("1",)) in hit and (2, 0, 0, ()) in hit and (4, 60_000, 0, ()) in hit
    elif name == "secrets":
        assert len(rows) == 5 and all(r.doc_id is None for r in rows)
    elif name == "html":
        assert len(rows) == 6 and {r.page_id: r.text for r in rows}[1] == "hi"
    elif name == "urls":
        verdicts = {r.page_id: (r.rule, r.verdict) for r in rows}
        assert len(rows) == 6 and verdicts[1] == ("org/", "allow") and verdicts[5] == ("com/fr/", "block") and verdicts[2] == (None, "allow")
    elif name == "shards":
        assert len({r.shard for r in rows}) == len(rows) == 9 and all(r.slot == 0 for r in rows)
    elif name == "suffixes":
        left = sorted((r.doc_id or 0, r.n_bytes, r.left) for r in rows)
        assert [x for x in left if x[0] == 1] == [(1, 2200, 0)] * 2 and (6, 600, 0) in left and (2, 0, 0) in left
    elif name == "mixing":
        assert {(r.doc_id, r.source) for r in rows} == {(d[0], d[3]) for d in DOCS}
    elif name == "telephony":
        assert len(rows) == 9
    elif name == "minhash":
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
        assert len(rows) == 9 and (1, 2, 1, True) in got and (2, 0, 2, True) in got and (6, 1, 6, True) in got
    else:
        assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
