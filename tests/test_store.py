"""The streaming store against a plain dictionary and the batch form: late rows, restarts, aliases, time to live."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarnwick.operators import state
from tarnwick.streaming import store

START = dt.datetime(2026, 1, 1)
SCHEMA = "ts timestamp, namespace string, event_id long, op string, key string, value string, ttl int"


def plain(calls, default):
    """Every call in order, over dictionaries."""
    out, spaces = {}, {}
    for ts, ns, event, op, key, value, ttl in sorted((c for c in calls if None not in (c[0], c[1], c[4])), key=lambda c: (c[0], c[2])):
        s = spaces.setdefault(ns, {"e": {}, "a": {}, "h": 0, "m": 0})
        life, found = default if ttl is None else ttl, None

        def alive(table, name, now=ts):
            got = table.get(name)
            return got[0] if got and now < got[1] else None

        if op in ("get", "contains", "delete"):
            found = alive(s["e"], key)
            if found is None and (target := alive(s["a"], key)) is not None:
                found = alive(s["e"], target)
        if op == "get":
            s["h" if found is not None else "m"] += 1
        elif op == "delete":
            s["e"].pop(key, None)
            s["a"].pop(key, None)
        elif op in ("set", "alias") and life > 0 and value is not None:
            until = ts + dt.timedelta(seconds=life)
            s["e" if op == "set" else "a"][key if op == "set" else value] = (value if op == "set" else key, until)
        out[event] = (op, found, s["h"], s["m"])
    return out


def made(n, seed):
    rng = random.Random(seed)
    ops = ["set", "set", "get", "get", "get", "alias", "delete", "contains", "odd"]
    rows = []
    for i in range(n):
        op, key = rng.choice(ops), f"k{rng.randrange(6)}"
        value = f"k{rng.randrange(9)}" if op == "alias" else f"v{i}"
        rows.append((START + dt.timedelta(seconds=20 * i), f"n{rng.randrange(3)}", i, op, key, value, rng.choice([None, None, 60, 900, 0])))
    return rows


def answered(spark, tmp_path, batches, ttl=600, name="answers"):
    """The stream run once for each batch of files, restarted from its checkpoint every time."""
    out = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = store.answers(stream, ttl, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        out[r.event_id] = (r.op, r.found, r.hits, r.misses)
    return out


END = (START + dt.timedelta(days=9), "end", 10**6, "get", "k", None, None)


def test_late_rows_and_restarts_give_the_plain_answers(spark, tmp_path):
    rows = made(240, 1)
    rng = random.Random(4)
    # rows come up to some 50 minutes late
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(150))
    parts = [shuffled[:80], shuffled[80:160] + [(None, "n0", 5000, "get", "k", None, None), (START, None, 5001, "get", "k", None, None)], shuffled[160:], [END]]
    got = answered(spark, tmp_path, parts)
    assert got == plain(rows, 600)


def test_equals_the_batch_form(spark, tmp_path):
    rows = [r for r in made(120, 2) if r[3] in ("set", "get", "delete")]
    got = answered(spark, tmp_path, [rows, [END]])
    df = spark.createDataFrame(rows, SCHEMA)
    want = state.keyed_values(df, ["namespace", "key"], "op", F.col("value"), F.col("ttl"), ["event_id"], ttl=600)
    assert {e: f for e, (op, f, _, _) in got.items() if op == "get"} == {r.event_id: r.found for r in want.where("op = 'get'").collect()}
    stats = want.where("op = 'get'").groupBy("namespace").agg(F.count("found").alias("h"), F.count_if(F.col("found").isNull()).alias("m")).collect()
    assert sum(r.h for r in stats) == sum(v[1] is not None for v in got.values() if v[0] == "get")


def test_calls_beyond_the_watermark_are_dropped(spark, tmp_path):
    early = (START, "n0", 1, "get", "a", None, None)
    later = (START + dt.timedelta(hours=5), "n0", 2, "set", "a", "v", None)
    got = answered(spark, tmp_path, [[later], [early], [END]])
    assert set(got) == {2}
