"""The search carries no texts through its ranks, reads shuffled sets once, and equals its SQL on odd pages."""

import random

import duckdb
import pytest

from tarnwick.operators import dedup, rank, similar
from tarnwick.plans import registry


def page(k, url, title, body):
    head = "" if title is None else f"<title>{title}</title>"
    return k, url, None if body is None else f"<html><head>{head}</head><body><p>{body}</p></body></html>"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(4)
    words = "the of and rend ant bee cat dog eel fox gnu hen ibis jay".split()
    text = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(n))
    long, rows = text(12), []
    for k in range(6):
        rows.append(page(k, f"http://h{k % 3}.example.org/{k}", f"a title of page {k} that is like no other {rng.random()}", text(12)))
    rows += [
        page(6, "http://h1.example.org/copy", "chunks of another page", long),
        page(7, "http://h2.example.org/copy", "chunks of that page again", long),
        page(8, "http://h0.example.org/0?utm_source=x", "the same url", text(12)),
        page(9, "http://x.example.net/9", "a domain that is left out", text(12)),
        page(10, "http://h3.example.org/none", None, "few words"),
        page(11, "http://h4.example.org/marks", "!!! ???", "..."),
        page(12, "http://h5.example.org/twice", "chunks of another page", text(3)),
        page(13, "no url", "no host. and the words of rend", ""),
        page(14, "http://h6.example.org/dots", "dots", ". . !!. " + text(12) + ". ?. of the and rend"),
    ]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return at


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["search_pipeline", "render_search"])
def test_odd_pages_equal_the_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{odd}/pages.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, odd)
    got = sorted(repr([plain(v) for v in r]) for r in df.collect())
    want = sorted(repr([plain(v) for v in r]) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE[name]}) AS q").fetchall())
    assert got == want and got


def test_no_text_goes_through_the_ranks(spark, odd, monkeypatch):
    """Scores and spread are worked out on numbers; texts are fetched for the ten results."""
    seen, real, top = [], rank.diversify, rank.top_k
    monkeypatch.setattr(rank, "diversify", lambda df, *a: seen.append(df.columns) or real(df, *a))
    monkeypatch.setattr(rank, "top_k", lambda df, *a: seen.append(df.columns) or top(df, *a))
    assert registry.QUERIES["search_pipeline"](spark, odd).count() > 0
    assert len(seen) == 2 and not {"content", "chunk", "title", "top"} & {c for x in seen for c in x}


def sets(spark):
    rng = random.Random(7)
    base = [rng.sample("abcdefghijklmnopqrstuvwxyz", 12) for _ in range(40)]
    rows = [(k, k * 2, [*rng.choice(base)[: rng.choice([11, 12])], *rng.choice([[], ["one"]])]) for k in range(300)]
    return spark.createDataFrame([*rows, (300, 600, []), (301, 602, [])], "id long, n long, w array<string>")


@pytest.mark.parametrize("most", [similar.SEND_ROWS, 0])
def test_kept_rows_are_those_not_dropped(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "SEND_ROWS", most)
    df = sets(spark)
    gone = {r.id for r in dedup.first_wins_sets(df, "id", "w", 0.75).collect()}
    kept = {(r.id, r.n) for r in dedup.first_wins_kept(df, "id", "w", 0.75, "n").collect()}
    assert kept == {(k, k * 2) for k in range(302) if k not in gone} and 100 < len(gone) < 300


def test_many_copies_are_parted_once(spark, monkeypatch):
    """Sets that are shuffled to leave their copies out are stored: the join reads them some times."""
    plans, real = [], similar.Similar.pairs
    monkeypatch.setattr(dedup, "SEND_ROWS", 0)
    monkeypatch.setattr(similar.Similar, "pairs", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df))
    dedup.first_wins_sets(sets(spark), "id", "w", 0.75).count()
    assert len(plans) == 1 and "Join" not in plans[0]
