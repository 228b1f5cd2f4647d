"""What the training-data operators share: the stored stages, row keys and numpy text kernels.

Tables between stages go to the folder named by ``spark.checkpoint.dir`` as Parquet, so a lost
executor costs a re-read and not a recomputation. Where that setting is absent, a temporary folder
serves on a single machine (a ``local`` master); on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd 64-bit constants of well-known mixers.
GOLDEN = U64(0x9E3779B97F4A7C15)
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)

#: Rows of one Arrow batch at most: texts may be long, and a batch is held in memory as a whole.
ARROW_ROWS = 500


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tarnwick-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = _own_dir()
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: the session's bound is lowered to ARROW_ROWS rows (stated in README)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, str(ARROW_ROWS))


#: Rows of an Arrow batch that holds numbers only.
NUMBERS = 20_000


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of another size for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Stash:
    """Tables written to the shared folder by one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again: its lineage ends here."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            path, files = self._files(name)
            files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        path, files = self._files()
        if files.exists(path):
            for each in files.listStatus(path):
                if each.getPath().getName() not in names:
                    files.delete(each.getPath(), True)


#: The two columns that name a row.
ROW = ("__row_a", "__row_b")


def row_keys(*cols: str) -> dict[str, Column]:
    """The 128-bit key of a row as two columns; rows that are equal in these columns share it.

    The seed stands first, so that the halves are independent hashes of the same values."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols]
    return {name: F.xxhash64(F.lit(seed), *values) for seed, name in enumerate(ROW, 1)}


def row_hash(*cols: str) -> Column:
    """Half of the row key, for places where rows of equal hash may share what they are given."""
    return row_keys(*cols)[ROW[0]]


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the columns that an operator doesn't read under names that it can't clash with, and the way back.

    The way back takes the worked table and the names of the results: the columns of ``docs`` as they
    were, but for those named like a result, and then the results."""
    hidden = {c: f"__in_{k}" for k, c in enumerate(docs.columns) if c not in used}
    before = docs.columns

    def back(out: DataFrame, *results: str) -> DataFrame:
        return out.select(*(F.col(hidden.get(c, c)).alias(c) for c in before if c not in results), *results)

    return docs.withColumnsRenamed(hidden), back


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column without copies per row, and the rows' offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; one longer row is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


#: Bytes that end a word in the near-duplicate operator: space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.full(64, 0x3C6EF372FE94F82B, U64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=U64)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and each row's first word (one more than rows).

    Words are maximal runs without white space, A-Z lower-cased."""
    rows = len(off) - 1
    if not len(raw):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, U64), first
    # bytes of white space count as zero, so that a run from one start to the next is the word
    local = np.arange(len(raw), dtype=np.int64)
    local[: starts[0]] = 0
    word = np.cumsum(begins) - 1
    np.maximum(word, 0, out=word)
    local -= starts[word]
    value = LOWER[raw].astype(U64) + U64(1)
    value[~inside] = 0
    far = local >= 64
    value *= _POWERS[local & 63]
    if far.any():  # longer words: each 64 bytes get another multiplier
        value[far] = mix(value[far] + (local[far] >> 6).astype(U64) * GOLDEN) * inside[far]
    sums = np.add.reduceat(value, starts)
    long = np.add.reduceat(inside.astype(np.int64), starts)
    return mix(sums + long.astype(U64) * GOLDEN), first


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles of ``size`` words as sorted 64-bit hashes.

    A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    words, first = word_hashes(raw, off)
    n = len(words)
    full = np.zeros(n, U64)
    if n >= size:
        m = n - size + 1
        acc = np.zeros(m, U64)
        for i in range(size):
            acc = (acc + words[i : i + m]) * MIX_B + U64(i + 1)
        full[:m] = mix(acc)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            acc = U64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    acc = (acc ^ w) * MIX_A + GOLDEN
            out.append(np.array([acc], U64))
        else:
            out.append(np.zeros(0, U64))
    return out
