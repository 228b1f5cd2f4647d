"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent (1: as
the corpus is, 0: all alike) is bisected until the weights meet an entropy, or until the most
repeated source is read as often as the limit allows. Without a token budget the budget is the
least that reads every source at least once, so nothing is lost.

The weights are then realised as block permutations: each pass over a source is a permutation by a
keyed hash; whole passes come first, a last part takes the rows whose running tokens stay within
the source's budget. Each source's stream is cut into as many blocks of equal tokens, so every block
has the target weights; within a block rows are ordered by hash.

Scale. Source totals are summed map-side. Running sums are two-level: 256 hash ranges of a source
are summed, and only the range where the budget ends is ordered, so a source that holds a third
of all rows isn't ordered in one task. The cut is one hash per source and pass; rows are judged in
place and texts never move. Tables of sources are broadcast up to ``SEND_ROWS`` rows, else joined.

Defined cases: null is a source of its own; sources without tokens are read once; rows with equal
ids stand or fall together in a part pass (ties of the order hash likewise), and share their block; repeated rows are
read as often each; ids may be of any type, null is one. An empty table gives an empty result. Extra columns pass
through; those named like a result (n_tokens, weight, epoch, block, place) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, apart

BETWEEN = r"[\x20\x09-\x0D]+"
RANGES, BLOCKS, STEPS = 256, 64, 60
REPEAT = 1.5
SEND_ROWS = 2_000
#: Rows of (source, tokens) up to which the bisection is done on the driver; beyond, each step is a small job.
DRIVER_ROWS = 100_000
#: Columns that the result adds.
RESULT = ("n_tokens", "weight", "epoch", "block", "place")
#: Bits of the order hash, 15 hexadecimal digits of an md5.
HASH_BITS = 60


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, BETWEEN), "")), F.lit(0)).cast("long")


def order_hash(id_col: str, epoch: Column) -> Column:
    key = F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), epoch.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def bisect(value: Callable[[float], float], target: float, steps: int = STEPS) -> float:
    """The exponent in [0, 1] where a falling function meets the target, from above."""
    lo, hi = 0.0, 1.0
    if value(lo) <= target:
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        if value(mid) > target:
            lo = mid
        else:
            hi = mid
    return hi


def exponent(totals: DataFrame, repeat: float | None = REPEAT, entropy: float | None = None) -> float:
    """The exponent for a repetition limit or an entropy (in nats) of (source, tokens)."""
    some = totals.where("tokens > 0")
    if entropy is None:
        low, high = some.agg(F.min("tokens"), F.max("tokens")).first()
        if not low:
            return 1.0
        return bisect(lambda a: (low / high) ** (a - 1), repeat or 1.0)
    if some.count() <= DRIVER_ROWS:
        sizes = [r[0] for r in some.select("tokens").collect()]

        def spread(a: float) -> float:
            top = max(sizes)
            w = [exp(a * log(x / top)) for x in sizes]
            return log(sum(w)) - sum(x * log(x) for x in w) / sum(w)
    else:
        top = some.agg(F.max("tokens")).first()[0]

        def spread(a: float) -> float:
            w = F.exp(a * F.log(F.col("tokens") / top))
            z, h = some.agg(F.sum(w), F.sum(w * F.log(w))).first()
            return log(z) - h / z

    return bisect(spread, entropy) if some.head(1) else 1.0


def plan(docs: DataFrame, stash: Stash, source: str, repeat: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """(_source, tokens, weight, take): tokens to take of each source."""
    totals = stash.put(docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("\x00null")).alias("_source")).agg(F.sum("_tokens").alias("tokens")), "totals")
    a = exponent(totals, repeat, entropy)
    high, total = totals.agg(F.max("tokens"), F.sum("tokens")).first()
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(high or 1), F.lit(a))).otherwise(0.0)
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    rate = F.pow(F.col("tokens") / F.lit(high or 1), F.lit(a - 1))
    take = F.floor(F.col("tokens") * rate) if budget is None else F.floor(F.lit(budget) * power / F.lit(z))
    return totals.select("_source", "tokens", (power / F.lit(z)).alias("weight"), F.when(F.col("tokens") > 0, take).otherwise(0).cast("long").alias("take"), F.lit(a).alias("exponent"))


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text", repeat: float | None = REPEAT, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``docs``, each row as often as the weights ask, with n_tokens, weight, epoch, block and place (order in the block)."""
    spark = docs.sparkSession
    stash = Stash(spark, "mixing")
    docs, back = apart(docs, source, id_col, text_col)
    counted = docs.withColumn("_tokens", n_tokens(text_col)).withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("\x00null")))
    narrow = stash.put(counted.select(F.col(id_col).alias("_id"), "_source", "_tokens"), "tokens")
    plans = stash.put(plan(narrow.withColumnRenamed("_source", source), stash, source, repeat, entropy, budget), "plan")
    n = plans.count()
    sent = F.broadcast(plans) if n <= SEND_ROWS else plans
    last = F.when(F.col("tokens") > 0, F.ceil(F.col("take") / F.col("tokens"))).otherwise(1)
    passes = lambda df, key: df.join(sent, "_source").withColumn("epoch", F.explode(F.when(last > 0, F.sequence(F.lit(0), last.cast("int") - 1)).otherwise(F.array().cast("array<int>")))).withColumn("place", order_hash(key, F.col("epoch")))
    range_of = F.shiftright("place", HASH_BITS - 8)
    rows = passes(narrow, "_id").withColumn("_range", range_of)
    sums = rows.groupBy("_source", "epoch", "_range").agg(F.sum("_tokens").alias("s"), F.first("tokens").alias("tokens"), F.first("take").alias("take"))
    run = Window.partitionBy("_source", "epoch").orderBy("_range")  # 256 rows at most
    sums = sums.withColumn("end", F.sum("s").over(run)).withColumn("left", F.col("take") - F.col("epoch") * F.col("tokens"))
    sums = stash.put(sums.withColumn("begin", F.col("end") - F.col("s")), "ranges")
    # where the budget ends: the rows of one range are ordered
    edge = sums.where("tokens > 0 and begin <= left and end > left").groupBy("_source", "epoch").agg(F.min(F.struct("_range", "begin", "left")).alias("e")).select("_source", "epoch", "e.*")
    within = rows.select("_source", "epoch", "_range", "place", "_tokens").join(F.broadcast(edge) if n <= SEND_ROWS else edge, ["_source", "epoch", "_range"])
    peers = Window.partitionBy("_source", "epoch", "_range").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = within.withColumn("sum", F.col("begin") + F.sum("_tokens").over(peers)).where("sum <= left")
    cuts = edge.join(within.groupBy("_source", "epoch").agg(F.max("place").alias("top")), ["_source", "epoch"], "left").select("_source", "epoch", F.coalesce("top", F.shiftleft(F.col("_range").cast("long"), HASH_BITS - 8) - 1).alias("cut"))
    starts = sums.groupBy("_source", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("_range", "begin"))).alias("_begins")).join(cuts, ["_source", "epoch"], "left")
    starts = stash.put(starts, "cuts")
    out = passes(counted.withColumn("_id", F.col(id_col)), "_id").join(F.broadcast(starts) if n <= SEND_ROWS else starts, ["_source", "epoch"])
    out = out.where("cut is null or place <= cut")
    at = F.col("epoch") * F.col("tokens") + F.element_at("_begins", range_of)
    block = F.when(F.col("take") > 0, F.least(F.floor(at * blocks / F.col("take")), F.lit(blocks - 1))).otherwise(0).cast("int")
    stash.keep("plan", "cuts")
    return back(out.withColumn("block", block).withColumnRenamed("_tokens", "n_tokens"), *RESULT)
