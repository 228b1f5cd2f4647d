"""Every registered query with SQL equals DuckDB on sf0.01; the entry query runs; streams equal batches."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnwick.operators import state
from tarnwick.plans import registry
from tarnwick.streaming import cache

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    rel = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE[name]}) AS q")
    want = sorted(repr([plain(v) for v in r]) for r in rel.fetchall())
    assert got == want and got


def test_queries_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, DATA).count() > 0


def test_diversify_keeps_rows(spark):
    assert registry.QUERIES["diversify"](spark, DATA).count() == 250


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("refresh", [False, True])
def test_streaming_cache_equals_the_batch(spark, tmp_path, refresh):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("user_id < 12").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = cache.flags(stream, refresh=refresh).writeStream.format("memory").queryName(f"flags{refresh}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.hit for r in spark.table(f"flags{refresh}").collect()}
    if refresh:
        want = {r.event_id: r.seen for r in state.seen_within(events, ["key"], ["event_id"]).collect()}
        assert got == want
    else:
        hits = state.replay(events, ["key"], F.lit(3600)).agg(F.sum("hits")).first()[0]
        assert len(got) == events.count() and sum(got.values()) == hits
