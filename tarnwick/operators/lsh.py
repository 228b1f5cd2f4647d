"""A stored index of near-duplicates that outlives its batches: probe, confirm, insert.

Rows are word sets. An index keeps, as Parquet under one path, the band hashes and the sets (words as 64-bit hashes) of the rows that it has kept. A
new batch is sketched, joined with the stored bands, and candidates are confirmed on the full sets; what resembles a stored row goes.
What is left is held against itself and the kept rows are appended, so feeding a table in batches, in order, gives what one pass
gives. With 32 bands of 4 a pair at a similarity of 0.75 is missed with probability 5e-6, at 0.5 it is a candidate in 87 of 100 cases.

A batch is held against itself: in each bucket a row is met with one earlier row whose sketch (a bit of each minimum) is like its own, so a
group of near copies costs its size and not its square. Rows that meet none are kept, rows that resemble one of those go. What is
left (near copies of near copies) is paired within buckets, exactly. Sketches tell unlike rows of a bucket apart, so only rows that may be
similar leave a join, and sets travel only for those; a pair at the threshold is taken for unlike with a probability of 1e-5.

Defined cases: rows without words are kept and never matched; null ids are not taken; rows of one id in a batch count as one, the ids of batches
have to ascend from batch to batch for the order of one pass. An index that isn't there is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.dedup import first_wins
from tarnwick.operators.rank import ranked
from tarnwick.operators.similar import DICTIONARY, SEND_ROWS, U64, _mixed, flat_numbers, numbers
from tarnwick.session import Parked

BANDS, WIDTH = 32, 4
#: A batch takes one round before the rest is paired within buckets; not a setting any more.
ROUNDS = 1


def band_rows(sets: DataFrame) -> DataFrame:
    """(id, s0, s1, buckets): of each set (id, w) of 64-bit numbers a bit of each of 128 minima and a bucket for each band; rows without words have none."""
    kind = sets.schema["id"].dataType.simpleString()
    return sets.where(F.size("w") > 0).select("id", "w").mapInArrow(_sketch, f"id {kind}, s0 long, s1 long, buckets array<long>")


_MULTIPLY = _mixed(np.arange(1, BANDS * WIDTH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            flat, off = flat_numbers(batch.column(1))
            flat, rows = _mixed(flat), batch.num_rows
            minima = np.empty((BANDS * WIDTH, rows), U64)
            for k, m in enumerate(_MULTIPLY):
                h = flat * m
                h ^= h >> U64(32)
                minima[k] = np.minimum.reduceat(h, off[:-1])
            bits = np.ascontiguousarray(np.packbits((minima & U64(1)).astype(np.uint8).T, axis=1)).view(np.int64)
            keys = np.empty((rows, BANDS), np.int64)
            for band in range(BANDS):
                acc = np.full(rows, band + 1, U64)
                for row in minima[band * WIDTH : (band + 1) * WIDTH]:
                    acc = _mixed((acc ^ row) * U64(0x9E3779B97F4A7C15))
                keys[:, band] = acc.view(np.int64)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), buckets], names=["id", "s0", "s1", "buckets"])


def _most(threshold: float) -> int:
    """Bits in which sketches of pairs at the threshold differ at most, but for 4.5 standard deviations."""
    q, n = (1 - threshold) / 2, BANDS * WIDTH
    return math.ceil(n * q + 4.5 * math.sqrt(n * q * (1 - q)))


def _met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the rows of two tables of bands that share a bucket and whose sketches don't tell them apart; nothing else leaves the join."""
    side = lambda df, x: df.select(F.col("id").alias(x), F.col("s0").alias(f"p{x}"), F.col("s1").alias(f"q{x}"), F.explode("buckets").alias("bucket"))
    apart = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb")))
    return side(left, "a").join(side(right, "b"), "bucket").where(apart <= _most(threshold)).select("a", "b")


def _first_met(threshold: float):
    """Rows (bucket, at, s0, s1), sorted by bucket and at, to (x, y): each row and an earlier one of its bucket that it may resemble.

    A group of near copies is held against its first row only, so it costs its size."""
    most = _most(threshold)

    def judged(at: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        first, out, i = np.full(len(at), -1), [], 0
        while True:
            rest = np.flatnonzero(first[i:] < 0)
            if not len(rest):
                break
            i += int(rest[0])
            like = np.bitwise_count(sig ^ sig[i]).sum(1, dtype=np.int64) <= most
            before = np.flatnonzero(like[:i])
            if len(before):
                first[i] = before[0]
            else:
                later = np.flatnonzero(like[i:] & (first[i:] < 0)) + i
                first[later] = i
            i += 1
        met = np.flatnonzero(at[first] != at)
        return [(at[first[met]], at[met])] if len(met) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def whole(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, at, sig = cols
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            lo, hi = np.concatenate(([0], cut)), np.append(cut, len(key))
            found = [p for k in np.flatnonzero(hi - lo > 1) for p in judged(at[lo[k] : hi[k]], sig[lo[k] : hi[k]])]
            x, y = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, at, s0, s1 = (batch.column(k).to_numpy() for k in range(4))
            cols, cut = [key, at, np.stack([s0, s1], axis=1).view(U64)], int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][-1] != key[0]):
                yield whole([np.concatenate(x) for x in zip(*held, [a[:cut] for a in cols], strict=True)])
                held = []
            held.append([a[cut:] for a in cols])
        if held:
            yield whole([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


def resembling(park: Parked, name: str, pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets, of ``left`` and ``right`` (id, w), have a Jaccard similarity of ``threshold`` or more; only their sets travel."""
    pairs = park.put(pairs.distinct(), f"{name}-pairs")
    wa = left.select(F.col("id").alias("a"), F.col("w").alias("wa")).join(_sent(pairs), "a")
    wb = right.select(F.col("id").alias("b"), F.col("w").alias("wb")).join(_sent(pairs.select("b").distinct()), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    return park.put(wa.join(wb, "b").where(both >= threshold * (F.size("wa") + F.size("wb") - both)).select("a", "b"), name)


def _kept(park: Parked, sets: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """Ids kept by a first-wins pass over (id, w) and their bands."""
    order = park.put(ranked(sets.select("id"), F.col("id"), name="at").withColumn("at", F.col("at").cast("long")), "order")
    each = bands.join(order, "id").select(F.explode("buckets").alias("bucket"), "at", "s0", "s1")
    met = each.repartition("bucket").sortWithinPartitions("bucket", "at").mapInArrow(_first_met(threshold), "x long, y long").distinct()
    met = met.join(order.select(F.col("at").alias("x"), F.col("id").alias("a")), "x").join(order.select(F.col("at").alias("y"), F.col("id").alias("b")), "y")
    met = park.put(met.select("a", "b"), "met")
    behind = park.put(met.select(F.col("b").alias("id")).distinct(), "behind")
    # no earlier row of any bucket is like these
    lead = order.select("id").join(behind, "id", "left_anti")
    sure = resembling(park, "sure", met.join(lead.select(F.col("id").alias("a")), "a", "left_semi"), sets, sets, threshold)
    gone = park.put(sure.select(F.col("b").alias("id")).distinct(), "gone")
    open_ = park.put(behind.join(gone, "id", "left_anti"), "open")
    # the rest is held against all that may be kept
    there = bands.join(_sent(gone), "id", "left_anti")
    rest = _met(there, bands.join(_sent(open_), "id", "left_semi"), threshold).where("a < b")
    rest = resembling(park, "rest", rest, sets, sets, threshold)
    return order.select("id").join(gone.unionByName(first_wins(rest)), "id", "left_anti")


@dataclass
class LshIndex:
    """The index under ``path``; batches are added in order."""

    spark: SparkSession
    path: str
    threshold: float = 0.75

    def _stored(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return self.spark.read.schema(schema).parquet(at)
        return self.spark.createDataFrame([], schema)

    def matches(self, batch: DataFrame) -> DataFrame:
        """(a, b): stored rows a that rows b of the batch (id, w) resemble."""
        park = Parked(self.spark, "neardup")
        sets = self._sets(park, batch)
        return self._matches(park, sets, band_rows(sets))

    def _sets(self, park: Parked, batch: DataFrame) -> DataFrame:
        """(id, w) with words as sorted 64-bit hashes, one row an id."""
        each = batch.where("id is not null").select("id", F.array_sort(F.array_distinct(numbers("w"))).alias("w"))
        each = park.put(each, "all", **DICTIONARY)
        twice = park.put(each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "twice")
        if not twice.head(1):
            return each
        once = each.join(_sent(twice), "id", "left_semi").dropDuplicates(["id"])
        return park.put(each.join(_sent(twice), "id", "left_anti").unionByName(once), "once", **DICTIONARY)

    def _matches(self, park: Parked, sets: DataFrame, bands: DataFrame) -> DataFrame:
        kind = sets.schema["id"].dataType.simpleString()
        known = self._stored("bands", f"id {kind}, s0 long, s1 long, buckets array<long>")
        return resembling(park, "stored", _met(known, bands, self.threshold), self._stored("sets", f"id {kind}, w array<long>"), sets, self.threshold)

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch (id, w): the ids that are kept, which the index holds from now on."""
        park = Parked(self.spark, "neardup")
        sets = self._sets(park, batch)
        bands = park.put(band_rows(sets), "bands")
        known = self._matches(park, sets, bands).select(F.col("b").alias("id")).distinct()
        # equal sets share all buckets and the fate of their first
        named = sets.select("id", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"), F.size("w").alias("n"))
        first = named.where("n > 0").groupBy("h", "g").agg(F.min("id").alias("id")).select("id").unionByName(named.where("n <= 0").select("id"))
        out = park.put(named.select("id").join(first, "id", "left_anti").unionByName(known).distinct(), "out")
        kept = _kept(park, sets.join(_sent(out), "id", "left_anti"), bands.join(_sent(out), "id", "left_anti"), self.threshold)
        kept = park.put(kept, "kept")
        lost = _sent(park.put(sets.select("id").join(kept, "id", "left_anti"), "lost"))
        bands.join(lost, "id", "left_anti").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/bands")
        sets.where("size(w) > 0").join(lost, "id", "left_anti").write.mode("append").options(compression="zstd", **DICTIONARY).parquet(f"{self.path}/sets")
        park.keep("kept")
        return kept
