"""Keyed state with a time to live, replayed from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL, FAILURE_TTL = 3600, 60


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


def seen_within(df: DataFrame, keys: list[str], order: list[str], ttl: int = TTL, ts: str = "ts") -> DataFrame:
    """``df`` with seen: the key was set less than ``ttl`` seconds ago; every event sets it anew."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    gap = seconds(ts) - F.lag(seconds(ts)).over(w)
    return df.withColumn("seen", F.coalesce(gap < ttl, F.lit(False)))


def replayed(df: DataFrame, keys: list[str], ttl: Column, order: list[str], ts: str = "ts") -> DataFrame:
    """(keys, order columns, hit) of each access to a read-through cache: a miss writes, hits don't refresh.

    Accesses of a key stream past in their order and only the entry's end is held, so no key's
    events are gathered."""
    rows = df.select(*keys, *order, seconds(ts).alias("_t"), ttl.cast("double").alias("_ttl"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_t", *order)
    n = len(keys)

    def run(frames):
        last, until = None, float("-inf")
        for frame in frames:
            hit = []
            columns = [frame[c].tolist() for c in keys]
            for *key, t, life in zip(*columns, frame["_t"].tolist(), frame["_ttl"].tolist(), strict=True):
                if key != last:
                    last, until = key, float("-inf")
                hit.append(t < until)
                if t >= until:
                    until = t + life
            yield frame[keys + order].assign(hit=hit)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: n + len(order)])
    return dealt.mapInPandas(run, fields + ", hit boolean")


def replay(df: DataFrame, keys: list[str], ttl: Column, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """(keys, hits, misses) of a read-through cache; accesses of one moment are taken with the shortest life first."""
    each = replayed(df.withColumn("_life", ttl), keys, F.col("_life"), ["_life"] + (order or []), ts)
    return each.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def keyed_values(calls: DataFrame, keys: list[str], op: str, value: Column, own_ttl: Column, order: list[str], ttl: int = TTL, ts: str = "ts") -> DataFrame:
    """``calls`` (op get, set, delete or contains) with ttl and found: what each call finds under its key.

    The last write before a call counts: a set until its time is over (an own time to live wins over
    the default, zero writes nothing), a delete for good. A default of zero disables the store."""
    resolved = F.lit(0) if ttl == 0 else F.coalesce(own_ttl, F.lit(ttl)).cast("int")
    rows = calls.withColumn("ttl", F.when(F.col(op) == "set", resolved))
    write = F.when((F.col(op) == "delete") | ((F.col(op) == "set") & (F.col("ttl") > 0)), F.struct(F.col(op).alias("op"), (seconds(ts) + F.coalesce("ttl", F.lit(0))).alias("until"), value.alias("value")))
    before = Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last(write, ignorenulls=True).over(before))
    alive = (F.col("_last.op") == "set") & (seconds(ts) < F.col("_last.until"))
    return rows.withColumn("found", F.when(alive, F.col("_last.value"))).drop("_last")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, ts: str = "ts", width: int = 3600) -> DataFrame:
    """``left`` with what ``right`` last held under the same keys: the value and time (``{value}``, ``{value}_ts``) of its latest row not after ``ts``.

    Both sides are merged by time buckets of ``width`` seconds. Inside a bucket of a key a window looks back; what a bucket leaves is
    carried to the later ones over a table with a row for each key and bucket. So no task orders a key's rows, only a bucket's, and a key with
    half of all rows is dealt by its buckets. Of right rows of one moment the largest value holds. Rows of null keys or times find nothing."""
    bucket = F.floor(seconds(ts) / width)
    asked = left.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_bucket": bucket, "_row": F.monotonically_increasing_id()})
    held = right.groupBy(*keys, F.col(ts)).agg(F.max(value).alias("_value")).dropna(subset=[*keys, ts])
    held = held.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_bucket": bucket})
    entry = F.struct(F.col("_at").alias("at"), F.col(ts).alias("ts"), F.col("_value").alias("value"))
    both = asked.withColumn("_entry", F.lit(None).cast(held.select(entry.alias("e")).schema["e"].dataType))
    both = both.unionByName(held.select(*keys, "_at", "_bucket", entry.alias("_entry")), allowMissingColumns=True)
    # right rows stand before left ones of their moment
    look = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_entry").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_last", F.last("_entry", ignorenulls=True).over(look)).where("_row is not null").drop("_entry")
    ends = held.groupBy(*keys, "_bucket").agg(F.max(entry).alias("_end"))
    marks = ends.unionByName(asked.select(*keys, "_bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket of a key
    carried = marks.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = inside.join(carried, [*keys, "_bucket"], "left").withColumn("_found", F.coalesce("_last", "_carry"))
    return out.select(*left.columns, F.col("_found.value").alias(value), F.col("_found.ts").alias(f"{value}_ts"))


def failure_ttl(status: Column, ttl: int = TTL, short: int = FAILURE_TTL) -> Column:
    return F.when(status == "ok", ttl).otherwise(min(short, ttl))
