"""As-of joins by buckets against a plain look back; a hot key is dealt over tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarnwick.operators import state

START = dt.datetime(2026, 1, 1)


def test_equals_a_plain_look_back(spark):
    rng = random.Random(6)
    at = lambda: START + dt.timedelta(seconds=rng.randrange(40_000))
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([at(), at(), at(), None])) for i in range(600)] + [(1000, "a", START), (1000, "a", START)]
    right = [(rng.choice(["a", "b", "c", None]), at(), i) for i in range(60)] + [("a", START, 7), ("a", START, 9), ("a", None, 5)]
    got = state.as_of(spark.createDataFrame(left, "id int, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v int"), ["k"], "v", width=1800).collect()

    def back(k, ts):
        if k is None or ts is None:
            return None, None
        found = max(((t, v) for key, t, v in right if key == k and t is not None and t <= ts), default=(None, None))
        return found[1], found[0]

    assert sorted(((r.id, r.k, r.ts, r.v, r.v_ts) for r in got), key=repr) == sorted(((i, k, ts, *back(k, ts)) for i, k, ts in left), key=repr)


def test_a_hot_key_is_dealt_by_its_buckets(spark):
    n = 100_000
    left = spark.range(n).select("id", F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    right = spark.range(0, n, 1000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.col("id").alias("v"))
    got = state.as_of(left, right, ["k"], "v")
    assert got.where(F.col("v") != F.floor(F.col("id") / 1000) * 1000).count() == 0 and got.count() == n
    # the window that looks back is dealt by key and bucket, never by the key alone
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", START)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([], "k string, ts timestamp, v int")
    assert [(r.id, r.v) for r in state.as_of(left, right, ["k"], "v").collect()] == [(1, None)]
    assert state.as_of(left.limit(0), right, ["k"], "v").collect() == []
