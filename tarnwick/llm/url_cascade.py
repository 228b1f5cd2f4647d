"""URL filters by Bloom filter cascades: exact membership without joins.

A list's keys and the complete universe of keys that the corpus can ask are known when the cascade
is built. Level 0 encodes the listed keys; level 1 the keys of the universe that level 0 takes for
listed by mistake; level 2 the listed keys that level 1 takes for mistakes, and so on until a level
makes none. For every key of the universe the first level that denies it gives the exact answer.

Keys of a url are its host and parent domains, each with the beginnings of its path in the lengths
that the list has; the longest listed key is the rule that applies.

Scale. Level 0 has a false-positive rate of about the ratio of listed to other keys, all others one
half; so all levels together take some 30 bits a listed key at most, whatever the corpus holds, and
that bound is checked (``MAX_BITS``) before they are sent out. Universe and levels are made with
distributed filters and summed bits; only bit words come to the driver. Judging a url is row by row.

Defined cases: a null url or one without ``://`` has an empty host and path, hence no key and the
verdict for what is not listed; an empty list blocks nothing; repeated rows are judged each. Of rules of equal
length (one allowed, one blocked: the same rule) the allowing one applies. An empty table gives an empty result. Extra
columns pass through; those named like a result (host, path, rule, verdict) are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, apart

#: Bits of one level at most (256 MB); a longer list has to be split by key hash into several cascades.
MAX_BITS = 1 << 31


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url that a list with these path lengths can hold."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    return F.when(host != "", F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


@dataclass
class Level:
    bits: int
    first: int  # number of the first probe: each level has probes of its own
    probes: int
    words: np.ndarray  # uint64

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        a, step = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for i in range(self.first, self.first + self.probes):
            at = (a + np.uint64(i) * step) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership of keys of the universe."""
        out = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            inside = level.has(h1[left], h2[left])
            out[left[~inside]] = k % 2 == 1
            left = left[inside]
        out[left] = len(self.levels) % 2 == 1
        return out


def _level(keys: DataFrame, bits: int, first: int, probes: int) -> Level:
    """Encode (h1, h2) rows; positions are unsigned, so they are taken from decimals exact for 64 bits."""
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is over the bound of {MAX_BITS}; split the list by key hash")
    step = F.col("h2").bitwiseOR(F.lit(1))
    # wrap-around sums without an overflow check: the two halves are added apart
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    at = []
    for i in range(first, first + probes):
        lo = low(F.col("h1")) + low(step) * i
        hi = (high(F.col("h1")) + high(step) * i + F.shiftright(lo, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        at.append(F.pmod((hi % bits) * (2**32 % bits) + low(lo) % bits, F.lit(bits)))
    rows = keys.select(F.explode(F.array(*at)).alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
    words = np.zeros((bits + 63) // 64, np.uint64)
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Level(bits, first, probes, words)


def _contains(spark: SparkSession, level: Level) -> Column:
    sent = spark.sparkContext.broadcast(level)

    def probe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(h1.to_numpy(), h2.to_numpy()))

    probe.__annotations__ = {"h1": pd.Series, "h2": pd.Series, "return": pd.Series}
    return F.pandas_udf(probe, "boolean")(F.col("h1"), F.col("h2"))


def build(listed: DataFrame, universe: DataFrame, key: str = "key") -> Cascade:
    """The cascade of ``listed`` keys, exact over ``universe``."""
    spark = listed.sparkSession
    stash = Stash(spark, "cascade")
    pair = lambda df: df.select(F.col(key).alias("key")).where("key is not null").distinct().withColumns(dict(zip(("h1", "h2"), hashes(F.col("key")), strict=True)))
    inside = stash.put(pair(listed), "in")
    outside = stash.put(pair(universe).join(inside, "key", "left_anti"), "out")
    cascade, n_in, n_out, k = Cascade(), inside.count(), outside.count(), 0
    take, others, n = inside, outside, n_in
    while n:
        rate = 0.5 if k else min(0.5, max(n_in * math.sqrt(0.5) / max(n_out, 1), 1e-9))
        probes = max(1, round(-math.log2(rate)))
        bits = max(67, math.ceil(n * probes / math.log(2))) | 1  # odd, so that no probe number is a multiple of it
        level = _level(take, bits, 64 * k, probes)
        cascade.levels.append(level)
        wrong = stash.put(others.where(_contains(spark, level)), f"wrong{k}")
        take, others, n, k = wrong, take, wrong.count(), k + 1
    stash.keep()
    return cascade


def listed_keys(spark: SparkSession, cascade: Cascade, keys: str) -> Column:
    """Those of an array of keys of the universe that are listed."""
    sent = spark.sparkContext.broadcast(cascade)

    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        n = [len(x) for x in h1]
        if not sum(n):
            return pd.Series([np.zeros(0, bool)] * len(n))
        flags = sent.value.has(np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64))
        return pd.Series(np.split(flags, np.cumsum(n)[:-1]))

    test.__annotations__ = {"h1": pd.Series, "h2": pd.Series, "return": pd.Series}
    one, two = F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])
    flags = F.pandas_udf(test, "array<boolean>")(one, two)
    return F.transform(F.filter(F.arrays_zip(F.col(keys).alias("k"), flags.alias("f")), lambda x: x["f"]), lambda x: x["k"])


def judge(urls: DataFrame, allow: list[str], block: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (null where none applies) and verdict."""
    spark = urls.sparkSession
    stash = Stash(spark, "urls")
    lengths = sorted({len(r) - r.index("/") for r in [*allow, *block]})
    urls, back = apart(urls, url_col)
    parts = urls.withColumn("host", host_of(url_col)).withColumn("path", path_of(url_col))
    keyed = parts.withColumn("_keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = stash.put(keyed.select(F.explode("_keys").alias("key")).distinct(), "universe")
    for name, rules in (("_allow", allow), ("_block", block)):
        cascade = build(spark.createDataFrame([(r,) for r in rules], "key string"), universe)
        keyed = keyed.withColumn(name, listed_keys(spark, cascade, "_keys"))
    longest = lambda c: F.element_at(F.sort_array(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), False), 1)
    keyed = keyed.withColumn("_a", F.when(F.size("_allow") > 0, longest(F.col("_allow")))).withColumn("_b", F.when(F.size("_block") > 0, longest(F.col("_block"))))
    allowed = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a.n") >= F.col("_b.n")))
    rule = F.when(allowed, F.col("_a.k")).otherwise(F.col("_b.k"))
    verdict = F.when(allowed, "allow").when(F.col("_b").isNotNull(), "block").otherwise(default)
    stash.drop("universe")
    return back(keyed.withColumn("rule", rule).withColumn("verdict", verdict), "host", "path", "rule", "verdict")
