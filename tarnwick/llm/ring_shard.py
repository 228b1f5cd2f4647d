"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64 bits. A key goes to the first point clockwise;
where that shard is full it continues clockwise to the next point of a shard with room. Capacities
are given, so balance is guaranteed: with ``slack`` 0 they are the row count dealt evenly (the
first ``rows mod shards`` shards take one more) and counts differ by one at most; with a slack of
c the bound is (1 + c) times the mean and fewer keys move when shards come or go.

Scale. Only the counts of arcs (shards x vnodes rows, a fixed number) reach the driver. There the
overflow of arcs is settled clockwise as counts; the result is a table of arc ranks to shards. A key
needs its rank within its arc: arcs are cut into ``cells`` equal parts of the key space, so that a
window covers 1/(arcs x cells) of the rows, and cell counts give the offsets. Keys are hashed, so
copies of a text or a hot source don't gather in an arc.

Defined cases: rows without an id are keyed by their size and CRC; rows with equal ids are one key, ordered by
size and CRC, and repeated rows get slots of their own in any order; ids may be of any type;
null text has size 8; an empty table gives an empty result. Extra columns pass through; those named like a result
(shard, slot; size, text_crc32 of ``measured``) are replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart

SHARDS, VNODES, CELLS = 24, 64, 16


def _hash64(x: int) -> int:
    """A fixed 64-bit mixer."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of all points, clockwise; places are signed 64-bit like Spark's hashes."""
    return sorted((_hash64(s << 20 | v) - 2**63, s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack) * 1_000_000) // (shards * 1_000_000))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc, (rows, shard, first slot) in rank order, by counts alone.

    Each arc's own shard takes what fits; the rest walks clockwise together with what other arcs
    pass on, and every point with room takes as much as it can. Two rounds of the ring are enough,
    since the capacities hold all rows."""
    n = len(points)
    used = [0] * len(room)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def take(arc: int, shard: int, most: int) -> int:
        k = min(most, room[shard] - used[shard])
        if k:
            out[arc].append((k, shard, used[shard]))
            used[shard] += k
        return k

    waiting: list[list[int]] = []  # [arc, rows], first come first served
    for i, (_, shard) in enumerate(points):
        rest = counts[i] - take(i, shard, counts[i])
        if rest:
            waiting.append([i, rest])
    # clockwise: a full shard passes on until a point with room comes
    carried: list[list[int]] = []
    by_arc = dict(waiting)
    for step in range(2 * n):
        if not by_arc and not carried:
            break
        i = step % n
        while carried and (k := take(carried[0][0], points[i][1], carried[0][1])):
            carried[0][1] -= k
            if not carried[0][1]:
                carried.pop(0)
        if i in by_arc:
            carried.append([i, by_arc.pop(i)])
    assert not by_arc and not carried, "capacities are too small"
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    places = [p for p, _ in points]
    more = [c for c in ("size", "text_crc32") if c in docs.columns]
    docs, back = apart(docs, id_col, *more)
    rows = docs.withColumn("_place", F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).otherwise(F.xxhash64(F.lit("\x00null"), *more)))
    rows = rows.withColumn("_arc", _steps(places)(F.col("_place"))).withColumn("_cell", F.pmod(F.shiftrightunsigned("_place", 7), F.lit(CELLS)).cast("int"))
    cells = rows.groupBy("_arc", "_cell").agg(F.count("*").alias("n")).collect()  # shards x vnodes x cells rows at most
    counts = [0] * len(points)
    first: list[tuple[int, int, int]] = []
    for arc, cell, k in sorted((r["_arc"], r["_cell"], r["n"]) for r in cells):
        first.append((arc, cell, counts[arc]))
        counts[arc] += k
    plan = settle(points, counts, capacities(sum(counts), shards, slack))
    spread = []
    for arc, parts in enumerate(plan):
        lo = 0
        for k, shard, slot in parts:
            spread.append((arc, lo, lo + k, shard, slot))
            lo += k
    offsets = spark.createDataFrame(first or [(0, 0, 0)], "_arc int, _cell int, _first long")
    spread_df = spark.createDataFrame(spread or [(0, 0, 0, 0, 0)], "_arc int, _lo long, _hi long, shard int, _slot long")
    parts = spread_df.groupBy("_arc").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "shard", "_slot"))).alias("_parts"))
    order = Window.partitionBy("_arc", "_cell").orderBy("_place", id_col, *more)
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    # both tables have at most shards x vnodes x cells rows
    ranked = ranked.join(F.broadcast(offsets), ["_arc", "_cell"]).join(F.broadcast(parts), "_arc").withColumn("_rank", F.col("_rank") + F.col("_first"))
    hit = F.element_at(F.filter("_parts", lambda p: (p["_lo"] <= F.col("_rank")) & (F.col("_rank") < p["_hi"])), 1)
    out = ranked.withColumn("_hit", hit).withColumn("shard", F.col("_hit.shard")).withColumn("slot", F.col("_hit._slot") + F.col("_rank") - F.col("_hit._lo"))
    return back(out, "shard", "slot")


def _steps(places: list[int]):
    """A column function: the number of the first ring point at or after a place (the first one past the end)."""

    def apply(place):
        # two levels: 64 coarse slices of the key space, then the few points of a slice
        width = 2**64 // 64
        coarse = F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(2**63))), 58)
        table = []
        for s in range(64):
            lo, hi = -(2**63) + s * width, -(2**63) + (s + 1) * width
            a, b = bisect_left(places, lo), bisect_left(places, hi)
            table.append(F.struct(F.lit(a).alias("a"), F.array(*[F.lit(p) for p in places[a:b]]).cast("array<bigint>").alias("p")))
        slice_ = F.element_at(F.array(*table), coarse.cast("int") + 1)
        n = slice_["a"] + F.size(F.filter(slice_["p"], lambda p: p < place))
        return F.when(n >= len(places), 0).otherwise(n).cast("int")

    return apply


def owners(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """``docs`` with the shard that an unbounded ring gives (one more shard takes rows only into itself)."""
    points = ring(shards, vnodes)
    arc = _steps([p for p, _ in points])(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))))
    return docs.withColumn("shard", F.element_at(F.array(*[F.lit(s) for _, s in points]), arc + 1))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with size (UTF-8 bytes plus 8) and text_crc32 of the text."""
    return docs.withColumn("size", (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")).withColumn("text_crc32", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
