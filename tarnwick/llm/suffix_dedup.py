"""Exact removal of repeated byte strings with difference-cover suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes; strings are
judged on the input.

1. Each window of LENGTH bytes is dealt by its least 32-gram hash. Consecutive windows with the same
   first place of the least hash form a segment, so equal windows are in different segments, and
   always meet under one hash, whatever surrounds them.
   A hash that occurs once in the corpus holds no repeat, and its segments end here.
2. Equal segments under a hash collapse to one class with a count before anything is moved.
3. Hashes with several different classes are settled on a suffix array of their texts: DC3 sorts
   sampled triples, recurses on their names (until names span LENGTH bytes), merges the remaining
   suffixes, and neighbours in the order are compared over LENGTH bytes.
4. What repeats is carried from the classes to their segments and merged per document.

Scale. The corpus moves as 32-byte segment records, about one for 85 bytes; texts move once for
the removal, and once, for classes only, for step 3. A hash whose different classes exceed
``GROUP_BYTES`` (a passage with many surroundings) doesn't go to one task: its windows are dealt by
their own 128-bit hashes and counted, exactly like the rest. Nothing is collected.

Defined cases: null is the empty text; a text of fewer than LENGTH bytes keeps all; rows equal in
every column are documents of their own, so such rows of LENGTH bytes or more lose everything. Ids may be of any
type and null. An empty table gives an empty result. Results have the columns named at ``remove_repeats`` only: extra
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MIX_A, MIX_B, ROW, U64, Stash, blocks, mix, row_keys, text_bytes

LENGTH, GRAM = 200, 32
#: An odd constant for the second hash.
OTHER = U64(0xD6E8FEB86659FD93)
#: Bytes of text in one suffix array, and of one hash's classes, at most.
ARRAY_BYTES, GROUP_BYTES = 1 << 20, 3 << 19
#: Class rows up to which they are sent to all tasks (40 bytes each) instead of moving texts to them.
SEND_ROWS = 1_500_000


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def gram_hashes(raw: np.ndarray, begin: U64 = GOLDEN, step: U64 = MIX_B) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 128 bytes from each place; those past the end mean nothing."""
    h = (raw.astype(U64) + U64(1)) * begin
    h ^= h >> U64(29)
    size, short = 1, h
    while size < 128:
        if size == GRAM:
            short = h
        nxt = h * step
        nxt += _shift(h, size)
        nxt ^= nxt >> U64(29)
        nxt *= MIX_A
        h, size = nxt, size * 2
    return short, h


def second_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the 128 bytes from each place, independent of the first."""
    return gram_hashes(raw, OTHER, GOLDEN)[1]


def window_hash(h128: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(h128[at] * GOLDEN + h128[at + LENGTH - 128])


def segments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(least hash, 128-bit content hash, row, start in the row, windows) of the segments of concatenated rows."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none, none
    grams, h128 = gram_hashes(raw)
    grams = mix(grams)
    least, size = grams, 1
    while size < 128:
        least = np.minimum(least, _shift(least, size))
        size *= 2
    span = LENGTH - GRAM + 1
    least = np.minimum(least, _shift(least, span - 128))
    lens = np.diff(off)
    row = np.repeat(np.arange(len(lens)), np.maximum(lens - LENGTH + 1, 0))
    base = np.concatenate(([0], np.cumsum(np.maximum(lens - LENGTH + 1, 0))))
    at = np.arange(len(row)) - base[row] + off[row]  # the places where windows start
    if not len(at):
        return none, none, none, none, none, none
    low = least[at]
    new = np.ones(len(at), bool)
    # a least gram that is left behind ends a segment even if another follows: periodic windows part
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (grams[at[:-1]] == low[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))  # at most LENGTH - GRAM + 1, so first and last window cover a segment
    first, last = at[begin], at[begin + size - 1]
    same = [mix(window_hash(h, first) * MIX_A + window_hash(h, last) + size.astype(U64)).view(np.int64) for h in (h128, second_hashes(raw))]
    return low[begin].view(np.int64), *same, row[begin], first - off[row[begin]], size


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_bytes(batch.column(2))
        key = [batch.column(i).to_numpy() for i in range(2)]
        for lo, hi in blocks(off, 1 << 18):
            m, sh, sk, row, start, size = segments(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            keys = [pa.array(k[lo:hi][row] if len(row) else row) for k in key]
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(sh), pa.array(sk), *keys, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["m", "sh", "sk", *ROW, "start", "size"])


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, their names (equal keys, equal names, from 1) and the number of names."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    s = keys[order]
    new[1:] = s[1:] != s[:-1]
    rank = np.cumsum(new)
    name = np.empty(len(keys), np.int64)
    name[order] = rank
    return order, name, int(rank[-1]) if len(rank) else 0


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (integers from 1 to 2**21) in the order of their first ``depth`` symbols at least.

    The difference cover of modulus 3: sampled places are those with a remainder of 1 or 2."""
    n = len(text)
    t = np.zeros(n + 6, np.int64)
    t[:n] = text
    if depth <= 3:
        return np.argsort((t[:n] << 42) | (t[1 : n + 1] << 21) | t[2 : n + 2], kind="stable")
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a last place of its own parts the halves
    sample = np.concatenate((one, two))
    order, name, distinct = _names((t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2])
    if distinct < len(sample):
        order = suffix_order(name, depth // 3 + 2)  # two names more: what is tied there is tied here
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(1, len(sample) + 1)
    else:
        rank_of = name
    rank = np.zeros(n + 6, np.int64)
    rank[sample] = rank_of
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << 22) | rank[rest + 1], kind="stable")]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    mod1, mod2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    # among suffixes that are equal to the asked depth any order will do; the running maximum keeps one
    single = lambda i: (t[i] << 22) | rank[i + 1]
    pair = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    before = np.searchsorted(np.maximum.accumulate(single(mod1)), single(rest), "right")
    before += np.searchsorted(np.maximum.accumulate(pair(mod2)), pair(rest), "right")
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    to = np.arange(len(rest)) + before
    out[to] = rest
    left = np.ones(n, bool)
    left[to] = False
    out[left] = sorted_sample
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each window start in the pieces (first ``sizes`` places from ``starts``), whether it equals another's."""
    place = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.zeros(len(text) + LENGTH + 8, np.uint8)
    padded[: len(text)] = text
    index = np.full(len(text), -1, np.int64)
    index[place] = np.arange(len(place))
    order = suffix_order(text.astype(np.int64) + 1, LENGTH)
    order = order[index[order] >= 0]
    a, b = order[:-1], order[1:]
    words = np.ndarray((len(padded) - 7,), np.uint64, padded.tobytes(), strides=(1,))
    alive = np.arange(len(a))
    for at in range(0, LENGTH, 8):
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    out = np.zeros(len(place), bool)
    out[index[a[alive]]] = True
    out[index[b[alive]]] = True
    return out


def _runs(flag: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to) of the runs of set places in each piece."""
    piece = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(flag)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(flag)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (piece[at][1:] != piece[at][:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return piece[at[begin]], local[at[begin]], local[at[end]] + 1 if len(at) else local[at]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (m, c, size, body), those of an m one after the other: runs of repeated windows."""
    held: list[tuple[int, int, int, bytes]] = []
    total = 0

    def solve() -> pa.RecordBatch:
        text = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(x[3]) for x in held])[:-1])).astype(np.int64)
        sizes = np.array([x[2] for x in held], np.int64)
        piece, lo, hi = _runs(repeated_windows(text, starts, sizes), sizes)
        c = np.array([x[1] for x in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c[piece]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["c", "lo", "hi"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and total >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield solve()
                held, total = [], 0
            held.append(row)
            total += len(row[3])
    if held:
        yield solve()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of classes (c, size, body) as 128-bit hashes."""
    for batch in batches:
        for c, size, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            raw = np.frombuffer(body, np.uint8)
            at = np.arange(size)
            w = [pa.array(window_hash(h, at).view(np.int64)) for h in (gram_hashes(raw)[1], second_hashes(raw))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, c)), pa.array(at.astype(np.int32)), *w], names=["c", "lo", "w1", "w2"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their classes: (m, c, size, body)."""
    for batch in batches:
        raw, off = text_bytes(batch.column(0))
        wanted = batch.column(1).to_pylist()
        out = [(x["m"], x["c"], x["size"], raw[off[i] + x["start"] : off[i] + x["start"] + x["size"] + LENGTH - 1].tobytes()) for i, each in enumerate(wanted) for x in each]
        for k in range(0, len(out), 4000):
            cols = list(zip(*out[k : k + 4000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["m", "c", "size", "body"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, runs) to (uid, n_bytes, spans, kept)."""
    for batch in batches:
        raw, off = text_bytes(batch.column(1))
        spans, kept = [], []
        for i, runs in enumerate(batch.column(2).to_pylist()):
            text, merged = raw[off[i] : off[i + 1]], []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in runs or ()):
                if merged and lo <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], hi)
                else:
                    merged.append({"start": lo, "stop": hi})
            keep = np.ones(len(text), bool)
            for x in merged:
                keep[x["start"] : x["stop"]] = False
            spans.append(merged)
            kept.append(text[keep].tobytes() if merged else text.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, stop>>, kept binary) of each row."""
    stash = Stash(docs.sparkSession, "suffix")
    texts = docs.select(*(k.alias(c) for c, k in row_keys(id_col, text_col).items()), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = f"{ROW[0]} long, {ROW[1]} long"
    records = texts.select(*ROW, "text").mapInArrow(_emit, f"m long, sh long, sk long, {key}, start int, size int")
    records = stash.put(records, "records")
    # written first: a join of two plain shuffles lets adaptive execution split the records of a hot hash
    often = stash.put(records.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"), "often")
    members = stash.put(records.join(often, "m", "left_semi"), "members")
    stash.drop("records", "often")
    # numbered as written: the number of a class is its name
    classes = members.groupBy("m", "sh", "sk").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "start", "size")).alias("r"))
    classes = stash.put(classes.select("m", "sh", "sk", "n", "r.*").withColumn("c", F.monotonically_increasing_id()), "classes")
    mixed = classes.groupBy("m").agg(F.count("*").alias("kinds"), F.sum(F.col("size") + LENGTH - 1).alias("bytes")).where("kinds > 1").select("m", (F.col("bytes") > GROUP_BYTES).alias("wide"))
    mixed = stash.put(mixed, "mixed")
    asked = stash.put(classes.join(mixed, "m").select("m", "c", *ROW, "start", "size", "wide"), "asked")
    per_text = asked.groupBy(*ROW).agg(F.collect_list(F.struct("m", "c", "start", "size")).alias("wanted"))
    if asked.count() <= SEND_ROWS:
        per_text = F.broadcast(per_text)
    # rows that are equal in every column share a key: one of their bodies is enough
    found = texts.join(per_text, list(ROW)).select("text", "wanted").mapInArrow(_bodies, "m long, c long, size int, body binary")
    bodies = stash.put(found, "bodies").join(asked.select("c", "wide"), "c")
    narrow = bodies.where("not wide").select("m", "c", "size", "body").repartition("m").sortWithinPartitions("m", "c")
    runs = narrow.mapInArrow(_dedup_then_settle, "c long, lo int, hi int")
    windows = stash.put(bodies.where("wide").select("c", "size", "body").mapInArrow(_windows, "c long, lo int, w1 long, w2 long").distinct(), "windows")
    twice = stash.put(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    wide = windows.join(twice, ["w1", "w2"], "left_semi").select("c", "lo", (F.col("lo") + 1).alias("hi"))
    parts = runs.union(wide).join(classes.where("n = 1").select("m", "sh", "sk", "c"), "c").select("m", "sh", "sk", "lo", "hi")
    whole = classes.where("n > 1").select("m", "sh", "sk", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    parts = stash.put(parts.union(whole), "parts")
    at = members.join(parts, ["m", "sh", "sk"]).select(*ROW, F.struct((F.col("start") + F.col("lo")).cast("long").alias("lo"), (F.col("start") + F.col("hi") + LENGTH - 1).cast("long").alias("hi")).alias("run"))
    # a row's runs are bounded by its length; repeated rows have the same
    gone = stash.put(at.distinct().groupBy(*ROW).agg(F.collect_list("run").alias("runs")), "runs")
    stash.keep("runs")
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.join(gone, list(ROW), "left").select("doc_id", "text", "runs").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def _dedup_then_settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def once() -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield batch.filter(pa.array([p != (pairs[i - 1] if i else last) for i, p in enumerate(pairs)], pa.bool_()))
            last = pairs[-1] if pairs else last

    yield from _settle(once())
