"""Ranks within groups and spreads over domains without a window of a whole group."""

import random

from pyspark.sql import functions as F

from tarnwick.operators import rank as R


def test_ranked_within_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(20)) for i in range(3000)]
    got = R.ranked_within(spark.createDataFrame(rows, "id int, g string, v int").repartition(5), "g", F.desc("v"), F.col("id")).collect()
    by = {}
    for i, g, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        by.setdefault(g, []).append(i)
    assert {(r.id, r["rank"]) for r in got} == {(i, k + 1) for ids in by.values() for k, i in enumerate(ids)}


def test_a_hot_group_is_dealt_over_partitions(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    ranked = R.ranked_within(df, "g", F.col("id"))
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan.split("Physical Plan")[0] or "row_number" not in plan
    assert ranked.where("g = 'hot'").agg(F.max("rank"), F.count_distinct("rank")).first() == (180_000, 180_000)


def test_diversify_is_round_robin_with_and_without_a_limit(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, d string, s double")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    queues = {}
    for r in order:
        queues.setdefault(r[1], []).append(r[0])
    want = [q[k] for k in range(200) for q in queues.values() if k < len(q)]
    full = [r.id for r in R.diversify(df, "d", None, -F.col("s"), F.col("id")).orderBy("spread").collect()]
    top = [r.id for r in R.diversify(df, "d", 12, -F.col("s"), F.col("id")).orderBy("spread").limit(12).collect()]
    assert full == want and top == want[:12]
