"""Pairs of strings that differ by few insertions and deletions: disjoint windows of one string, met by all windows of the other.

A change falls into one of several disjoint windows at most. So of any k + 1 disjoint windows of a string one stands in each string
that is k changes away, shifted by k at most. Which ones is free: those are taken that are rarest by a sketch of counts, of the window
length that is cheaper (long ones tell running text apart, short ones the few characters in which titles of one pattern differ). The
other string is dealt by those of its windows only that some string has taken, by a bitmap of them; so rows grow with the input, and
no pair is made but of windows at fitting places in strings of fitting lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.similar import SKETCH, U64, _mixed, at_most, sketched
from tarnwick.session import checkpointed

#: Bits of the bitmap of taken windows, and of a row of it.
BITS, ROW = 1 << 26, 1 << 15
#: Length from which windows are taken at even distances, whatever their counts.
EVEN = 2000
#: Characters that are worked at once.
AT_ONCE = 500_000
SHORT = 3


def edits(share: float, n):
    """Changes between a string of n characters and its longest fitting partner."""
    return np.floor(2 * share / (1 - share) * n + 1e-9).astype(np.int64)


def sizes(share: float) -> tuple[int, ...]:
    """Window lengths of which k + 1 fit into any string that allows k changes."""
    longest = shortest(share) // 2
    return tuple(sorted({min(SHORT, longest), longest}))


def shortest(share: float) -> int:
    """The least length that allows a change."""
    return math.ceil((1 - share) / (2 * share) - 1e-6)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(c, g, characters) of the rows of one length, some at a time."""
    c, g, t = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64), batch.column(2).to_pylist()
    n = np.array([len(x) for x in t], np.int64)
    for length in np.unique(n).tolist():
        rows = np.flatnonzero(n == length)
        for at in np.array_split(rows, len(rows) * length // AT_ONCE + 1):
            if len(at):
                yield c[at], g[at], np.frombuffer("".join(t[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), length)


def _keys(g: np.ndarray, chars: np.ndarray, size: int) -> np.ndarray:
    """(rows x places) hashes of the windows of a size, apart by group and size."""
    places = chars.shape[1] - size + 1
    out = np.zeros((len(g), places), U64)
    for i in range(size):
        out = out * U64(0x100000001B3) + chars[:, i : i + places]
    return _mixed(out ^ _mixed(g + U64(size))[:, None])


def _rarest(cost: np.ndarray, size: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x many) places of disjoint windows of the least sum of costs, and the sums."""
    rows, places = cost.shape
    best, steps = np.zeros((rows, places + size)), []  # by the windows' end
    for _ in range(many):
        best = np.concatenate([np.full((rows, size), np.inf), np.minimum.accumulate(best[:, :places] + cost, axis=1)], axis=1)
        steps.append(best)
    end, out = np.full(rows, places + size - 1), np.zeros((rows, many), np.int64)
    for k in range(many - 1, -1, -1):
        end = np.argmax(steps[k] <= np.take_along_axis(steps[k], end[:, None], 1), axis=1)
        out[:, k] = end = end - size
    return out, best[:, -1]


def _rows(key: np.ndarray, c: np.ndarray, at: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c), pa.array(at.astype(np.int32)), pa.array(np.full(len(c), n, np.int32))], names=["key", "c", "at", "n"])


def every(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(c, g, t) to the hashes (w) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, g, chars in _blocks(batch):
                for size in sizes(share):
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(g, chars, size).ravel().view(np.int64))], names=["w"])

    return run


def taken(share: float, sketch: Callable[[], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(c, g, t) to the windows (key, c, at, n) that are looked for in other strings: one more than changes are allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch(), np.uint8)
        for batch in batches:
            for c, g, chars in _blocks(batch):
                n = chars.shape[1]
                many, least = int(edits(share, n)) + 1, np.full(len(c), np.inf)
                key, at = np.zeros((len(c), many), U64), np.zeros((len(c), many), np.int64)
                for size in sizes(share):
                    own = _keys(g, chars, size)
                    cost = at_most(counts[(own & U64(SKETCH - 1)).astype(np.int64)])
                    if n < EVEN:
                        places, total = _rarest(cost, size, many)
                    else:
                        places = np.tile(np.arange(many) * n // many, (len(c), 1))
                        total = np.take_along_axis(cost, places, 1).sum(1)
                    better = total < least
                    least = np.where(better, total, least)
                    key[better], at[better] = np.take_along_axis(own, places, 1)[better], places[better]
                yield _rows(key.ravel(), np.repeat(c, many), at.ravel(), n)

    return run


def looked_for(share: float, bits: Callable[[], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(c, g, t) to those of all windows (key, c, at, n) that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits(), np.uint8)
        for batch in batches:
            for c, g, chars in _blocks(batch):
                for size in sizes(share):
                    key = _keys(g, chars, size)
                    bit = (key & U64(BITS - 1)).astype(np.int64)
                    row, at = np.nonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    yield _rows(key[row, at], c[row], at, chars.shape[1])

    return run


def packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, at) to (block, bytes) with these bits set."""
    block, held = None, np.zeros(ROW, bool)
    done = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["block", "bytes"])
    for batch in batches:
        b, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = (np.flatnonzero(np.diff(b)) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, len(b)], strict=True):
            if lo == hi:
                continue
            if b[lo] != block:
                if block is not None:
                    yield done()
                block, held = int(b[lo]), np.zeros(ROW, bool)
            held[at[lo:hi]] = True
    if block is not None:
        yield done()


def _bitmap(keys: DataFrame) -> bytes:
    each = keys.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("b")).distinct()
    each = each.select(F.shiftright("b", ROW.bit_length() - 1).alias("block"), F.col("b").bitwiseAND(F.lit(ROW - 1)).alias("at"))
    out = np.zeros(BITS // 8, np.uint8)
    # 2,048 rows of 4 KB, whatever the input
    for r in each.repartition("block").sortWithinPartitions("block").mapInArrow(packed_bits, "block int, bytes binary").collect():
        out[r.block * ROW // 8 : (r.block + 1) * ROW // 8] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return out.tobytes()


def candidates(strings: DataFrame, share: float) -> DataFrame:
    """(x, y) of the strings (c, g, t) of one group that may differ by no more than ``share`` of their lengths' sum; x is the shorter.

    ``strings`` is read some times: it has to be stored, with different numbers c."""
    sc, rows, schema = strings.sparkSession.sparkContext, strings.select("c", F.xxhash64("g").alias("g"), "t"), "key long, c long, at int, n int"
    sketch = sc.broadcast(sketched(rows.mapInArrow(every(share), "w long")))
    own = checkpointed(rows.mapInArrow(taken(share, lambda: sketch.value), schema))
    bits = sc.broadcast(_bitmap(own))
    other = rows.mapInArrow(looked_for(share, lambda: bits.value), schema)
    x, y = own.select("key", *[F.col(k).alias(f"{k}x") for k in ("c", "at", "n")]), other.select("key", *[F.col(k).alias(f"{k}y") for k in ("c", "at", "n")])
    most, more = share * (F.col("nx") + F.col("ny")) + 1e-9, F.col("ny") - F.col("nx")
    # of the changes before a window, and of all, deletions are the fewer by the difference of the lengths
    fits = ((more > 0) | ((more == 0) & (F.col("cx") < F.col("cy")))) & (more <= most) & (F.abs(2 * (F.col("aty") - F.col("atx")) - more) <= most)
    return x.join(y, "key").where(fits).select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
