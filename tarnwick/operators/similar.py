"""Exact similarity join of sets of 64-bit numbers: rarest numbers first, small rows, no text in a shuffle.

Numbers are ordered from rare to frequent, by a sketch of their counts (any fixed order is exact, a good one is fast). Similar sets share
a number among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set, so these are dealt
by the number and sorted by size: a row meets those rows of its number only that are of fitting size. In the same task a pair goes whose
places or whose counts by cell (64 of 4 bits, which differ by no more than the sets do) leave too few common numbers. A number of very
many rows is dealt in tiles. Larger sets need more cells: those of the largest ones are held by every task (32 MB at most). What is left is
counted on the sets, which travel only for such pairs, once to a task of their cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.session import Parked

#: Buckets of the sketch of counts, one byte each, and rows of it that are packed together.
SKETCH, PACK = 1 << 22, 1 << 12
#: Rows of one number that one task pairs; more are dealt in tiles.
HOT = 1 << 14
#: Pairs that are judged at once.
PAIRS = 1 << 18
#: Cells of the rows that are dealt; sizes of sets from which pairs are judged again, by so many cells.
CELLS = 64
FINER = ((1600, 1024),)
#: Cells of the larger sets that every task holds, the size from which a set is large, and bytes of those cells at most (then the size is raised).
HELD, LARGE, HELD_BYTES = 256, 384, 32_000_000
SIGNATURE = [f"s{k}" for k in range(CELLS // 16)]
#: Rows of keys, and bytes of cells, up to which they are sent to every task instead of a shuffle.
SEND_ROWS, SEND_BYTES = 1_000_000, 64_000_000
#: Sets of a cluster that one task holds; larger clusters are cut, and two parts are one task's work.
TILE = 4096
#: Words come again and again: a large dictionary makes sets of their hashes small.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}
U64 = np.uint64


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0 and 1 as they are, then eight steps to a doubling, never too low."""
    return np.where(counts < 2, counts, np.minimum(np.ceil(8 * np.log2(np.maximum(counts, 2))) - 6, 255)).astype(np.uint8)


def at_most(code: np.ndarray) -> np.ndarray:
    """The largest count of a byte."""
    return np.where(code < 2, code, 2 ** ((code.astype(float) + 6) / 8))


def packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, at, rows) to (block, bytes)."""
    block, held = None, np.zeros(PACK, np.uint8)
    for batch in batches:
        b, at, rows = (batch.column(i).to_numpy() for i in range(3))
        code = _coded(rows)
        cut = np.flatnonzero(np.diff(b)) + 1
        for lo, hi in zip(np.concatenate(([0], cut)), np.append(cut, len(b)), strict=True):
            if lo == hi:
                continue
            if b[lo] != block:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([held.tobytes()])], names=["block", "bytes"])
                block, held = int(b[lo]), np.zeros(PACK, np.uint8)
            held[at[lo:hi]] = code[lo:hi]
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([held.tobytes()])], names=["block", "bytes"])


def flat_numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows as unsigned ones, and the rows' offsets."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(U64), off - off[0]


def _cells(flat: np.ndarray, row: np.ndarray, rows: int, cells: int = CELLS, shift: int = 40) -> np.ndarray:
    """(rows x cells) counts of each row's numbers by cell, modulo 16."""
    cell = ((flat >> U64(shift)) % U64(cells)).astype(np.int64)
    return (np.bincount(row * cells + cell, minlength=rows * cells) & 15).astype(np.uint8).reshape(rows, cells)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(27))


def prefixes(threshold: float, sketch: Callable[[], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(c, w) to a row for each of the first numbers of each set: (key, n, at, c, s0 ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch(), np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                flat, off = flat_numbers(batch.column(1))
                n = np.diff(off)
                rows = len(n)
                row = np.repeat(np.arange(rows), n)
                code = counts[(flat & U64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((flat, code, row))
                at = np.arange(len(flat)) - off[row]  # rows stand in their order
                first = np.flatnonzero((at < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]) & (code[order] != 1))
                pick = order[first]
                sig = _cells(flat, row, rows)
                sig = np.ascontiguousarray(sig[:, ::2] | (sig[:, 1::2] << 4)).view(np.int64)
                key, of, at = flat[pick], row[pick], at[first]
                parts = np.ceil(at_most(code[pick]) / HOT).astype(np.int64)
                if (parts > 1).any():  # each part meets each in a tile
                    c = batch.column(0).to_numpy()
                    own = (_mixed(c[of].view(U64)) % parts.astype(U64)).astype(np.int64)
                    rep = np.repeat(np.arange(len(pick)), parts)
                    other = np.arange(len(rep)) - (np.cumsum(parts) - parts)[rep]
                    low, high = np.minimum(own[rep], other), np.maximum(own[rep], other)
                    key, of, at = np.where(parts[rep] > 1, _mixed(key[rep] ^ _mixed((low << 32 | high).view(U64) + U64(1))), key[rep]), of[rep], at[rep]
                cols = [key.view(np.int64), n[of].astype(np.int32), at.astype(np.int32), batch.column(0).to_numpy()[of], *sig[of].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["key", "n", "at", "c", *SIGNATURE])

    return run


def _judge(threshold: float, large: tuple[np.ndarray, np.ndarray], key: np.ndarray, n: np.ndarray, at: np.ndarray, c: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of c, and the sum of their sizes, among rows of whole keys, sorted by (key, n)."""
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    nibbles = np.ascontiguousarray(sig).view(np.uint8)
    cells = np.concatenate([nibbles << 4, nibbles & 240], axis=1).view(np.int8)  # in the upper bits, so that differences wrap
    index = at < n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
    left = np.flatnonzero(index)
    place = group << 32 | n
    lo = np.searchsorted(place[left], group << 32 | np.ceil(threshold * n - 1e-9).astype(np.int64))
    many = np.maximum(np.cumsum(index) - index - lo, 0)
    ends = np.cumsum(many)
    j0 = 0
    while j0 < len(n):
        before = ends[j0 - 1] if j0 else 0
        j1 = max(j0 + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        j = np.repeat(np.arange(j0, j1), many[j0:j1])
        if len(j):
            i = left[lo[j] + np.arange(len(j)) - (ends - many)[j] + before]
            total = n[i] + n[j]
            common = threshold / (1 + threshold) * total - 1e-6
            fit = np.flatnonzero(np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= common)
            i, j, most = i[fit], j[fit], (total - 2 * common)[fit]
            fit = np.abs((cells[i] - cells[j]).astype(np.int16)).sum(1, dtype=np.int64) <= 16 * most
            i, j, most = i[fit], j[fit], most[fit]
            if len(i) and len(large[0]):
                x, y = (np.minimum(np.searchsorted(large[0], c[k]), len(large[0]) - 1) for k in (i, j))
                known = np.flatnonzero((large[0][x] == c[i]) & (large[0][y] == c[j]))
                keep = np.ones(len(i), bool)
                for some in np.array_split(known, len(known) // 50_000 + 1):
                    keep[some] = _apart(large[1][x[some]], large[1][y[some]]) <= 16 * most[some]
                i, j = i[keep], j[keep]
            if len(i):
                yield np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), n[i] + n[j]
        j0 = j1


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 times the difference of the counts, modulo 16, of rows of packed cells."""
    return sum(np.abs((x - y).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x, y in ((a << 4, b << 4), (a & 240, b & 240)))


def meetings(threshold: float, held: Callable[[], tuple[bytes, bytes]] = lambda: (b"", b"")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, n, at, c, s0 ...), sorted by (key, n), to candidates (x, y, total), x < y, with the sum of their sizes."""

    def rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, n, at, c, *sig = (batch.column(k).to_numpy() for k in range(batch.num_columns))
        return [key, n.astype(np.int64), at.astype(np.int64), c, np.stack(sig, axis=1)]

    def pairs(large: tuple[np.ndarray, np.ndarray], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = cols[0]
        alone = np.concatenate(([True], key[1:] != key[:-1])) & np.concatenate((key[1:] != key[:-1], [True]))
        some = np.flatnonzero(~alone)
        if len(some):
            for x, y, total in _judge(threshold, large, *(a[some] for a in cols)):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(total.astype(np.int32))], names=["x", "y", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cells = held()
        large = np.frombuffer(names, np.int64), np.frombuffer(cells, np.uint8).reshape(-1, HELD // 2)
        open_: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = rows_of(batch)
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            if cut or (open_ and open_[-1][0][-1] != cols[0][0]):
                yield from pairs(large, [np.concatenate(x) for x in zip(*open_, [a[:cut] for a in cols], strict=True)])
                open_ = []
            open_.append([a[cut:] for a in cols])
        if open_:
            yield from pairs(large, [np.concatenate(x) for x in zip(*open_, strict=True)])

    return run


def cells_of(cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(c, w) to (c, cells): the counts by so many cells, two to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                flat, off = flat_numbers(batch.column(1))
                row = np.repeat(np.arange(batch.num_rows), np.diff(off))
                sig = _cells(flat, row, batch.num_rows, cells)
                out = [x.tobytes() for x in sig[:, ::2] | (sig[:, 1::2] << 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["c", "cells"])

    return run


def finer(threshold: float, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(x, y, total, cx, cy) to the pairs (x, y, total) whose cells, where both have them, leave enough common numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                total = batch.column(2).to_numpy()
                keep = np.ones(batch.num_rows, bool)
                some = np.flatnonzero(~(batch.column(3).is_null().to_numpy(False) | batch.column(4).is_null().to_numpy(False)))
                if len(some):
                    at = pa.array(some)
                    x, y = (np.frombuffer(b"".join(batch.column(k).take(at).to_pylist()), np.uint8).reshape(len(some), cells // 2) for k in (3, 4))
                    keep[some] = _apart(x, y) <= 16 * (total[some] - 2 * (threshold / (1 + threshold) * total[some] - 1e-6))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(3)], names=["x", "y", "total"])

    return run


def counted(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (tile, part, c, w, partners) to (x, y, both): of each tile the listed pairs that are similar."""

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        sets = {c: w for c, w, _ in rows}
        out = []
        for c, w, partners in rows:
            for d in partners:
                v = sets[d]
                both = len(np.intersect1d(w, v, assume_unique=True))
                if both >= threshold * (len(w) + len(v) - both):
                    out.append((c, d, both))
        x, y, both = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(both, pa.int32())], names=["x", "y", "both"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for batch in batches:
            flat, off = flat_numbers(batch.column(3))
            for k, (tile, part, c, partners) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
                if (tile, part) != here:
                    yield pairs(rows)
                    here, rows = (tile, part), []
                rows.append((c, flat[off[k] : off[k + 1]].copy(), partners or ()))
        yield pairs(rows)

    return run


def numbers(words: Column | str) -> Column:
    """A set of words as 64-bit hashes."""
    return F.transform(words, lambda w: F.xxhash64(w))


def sketched(each: DataFrame) -> bytes:
    """The counts of numbers (w) by bucket, as bytes."""
    each = each.groupBy(F.col("w").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("b")).agg(F.count("*").alias("rows"))
    each = each.select(F.shiftright("b", PACK.bit_length() - 1).alias("block"), F.col("b").bitwiseAND(F.lit(PACK - 1)).alias("at"), "rows")
    out = np.zeros(SKETCH, np.uint8)
    # 1,024 rows of 4 KB, whatever the input
    for r in each.repartition("block").sortWithinPartitions("block").mapInArrow(packed_counts, "block int, bytes binary").collect():
        out[r.block * PACK : (r.block + 1) * PACK] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return out.tobytes()


def few(df: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """``df``, sent to every task if it has so few rows. It is read for that: it has to be stored."""
    return F.broadcast(df) if df.count() <= most else df


class Similar:
    """The similarity join of (id, c, w): c numbers the rows, w are distinct numbers. Its tables lie in a folder of their own."""

    def __init__(self, spark: SparkSession, threshold: float) -> None:
        self.spark, self.threshold, self.park = spark, threshold, Parked(spark, "similar")

    def stored(self, df: DataFrame) -> DataFrame:
        """(id, w) with its rows numbered, written once."""
        return self.park.put(df.withColumn("c", F.monotonically_increasing_id()), "sets", **DICTIONARY)

    def _large(self, sets: DataFrame) -> tuple[bytes, bytes]:
        """Names and cells of the largest sets, in the order of the names: some 250,000 at most."""
        octaves = sets.where(F.size("w") >= LARGE).groupBy(F.floor(F.log2(F.size("w")) * 8).alias("o")).agg(F.min(F.size("w")).alias("n"), F.count("*").alias("rows")).collect()
        least, rows = None, 0
        for o in sorted(octaves, reverse=True):
            rows += o["rows"]
            if rows > HELD_BYTES // (HELD // 2):
                break
            least = o.n
        if least is None:
            return b"", b""
        known = sets.where(F.size("w") >= least).select("c", "w").mapInArrow(cells_of(HELD), "c long, cells binary").toArrow().sort_by("c")
        return known["c"].to_numpy().tobytes(), b"".join(known["cells"].to_pylist())

    def pairs(self, sets: DataFrame) -> DataFrame:
        """(x, y, both): the numbers of the rows that are similar, x < y."""
        park, sets = self.park, sets.where(F.size("w") > 0)
        sketch = self.spark.sparkContext.broadcast(sketched(sets.select(F.explode("w").alias("w"))))
        large = self.spark.sparkContext.broadcast(self._large(sets))
        schema = "key long, n int, at int, c long, " + ", ".join(f"{s} long" for s in SIGNATURE)
        first = sets.select("c", "w").mapInArrow(prefixes(self.threshold, lambda: sketch.value), schema)
        met = first.repartition("key").sortWithinPartitions("key", "n").mapInArrow(meetings(self.threshold, lambda: large.value), "x long, y long, total int")
        met = park.put(met.groupBy("x", "y").agg(F.first("total").alias("total")), "met")
        for k, (least, cells) in enumerate(FINER):
            known = park.put(sets.where(F.size("w") >= least).select("c", "w").mapInArrow(cells_of(cells), "c long, cells binary"), f"cells{k}")
            known = few(known, SEND_BYTES * 2 // cells)
            side = lambda x, known=known: known.select(F.col("c").alias(x), F.col("cells").alias(f"c{x}"))
            judged = met.where(F.col("total") >= 2 * least).join(side("x"), "x", "left").join(side("y"), "y", "left").select("x", "y", "total", "cx", "cy")
            judged = judged.mapInArrow(finer(self.threshold, cells), "x long, y long, total int")
            met = park.put(met.where(F.col("total") < 2 * least).unionByName(judged), f"met{k}")
        return self._counted(sets, met.select("x", "y"))

    def _counted(self, sets: DataFrame, met: DataFrame) -> DataFrame:
        """Pairs are dealt by the least partner of x, so that a set goes to the tasks of its cluster and not to each of its partners."""
        park = self.park
        both = met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("g"))
        dealt = park.put(met.join(least, "x"), "dealt")
        members = dealt.select("g", F.explode(F.array("x", "y")).alias("c")).distinct()
        sizes = park.put(members.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "sizes")
        part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
        dealt = dealt.join(sizes, "g").withColumn("part", part("x") * F.col("parts") + part("y"))
        rows = dealt.select("g", "part", F.col("x").alias("c"), F.col("y").alias("d")).unionByName(dealt.select("g", "part", F.col("y").alias("c"), F.lit(None).cast("long").alias("d")))
        rows = park.put(rows.groupBy("g", "part", "c").agg(F.collect_set("d").alias("d")), "rows")
        full = sets.select("c", "w").join(few(rows), "c").select("g", "part", "c", "w", "d")
        return park.put(full.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(counted(self.threshold), "x long, y long, both int"), "pairs")
