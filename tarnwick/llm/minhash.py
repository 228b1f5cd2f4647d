"""MinHash near-duplicates with b-bit signatures.

Sketch: 128 minima of each document's distinct 5-word shingles. Bands of 4 minima give candidates
(at a similarity of 0.75 all 32 bands miss with probability 5e-6). The 2 low bits of every minimum
are packed in four 64-bit words; equal bits happen by chance in a quarter of the places, so the
estimate is (matches/128 - 1/4) / (3/4). Candidates whose estimate is 4.3 standard deviations under
the threshold are left out, all others are confirmed on the full sets.

Scale. Equal sets collapse to one class before banding; a class is named by its number in the
written table of classes, so no hash stands for it. In a bucket no class meets all others: rows
stream past the bucket's leaders (classes that resemble no earlier leader surely), so a bucket of
near copies yields a star of one candidate a row and is held as its leaders only. Hot buckets are
parted by a hash of the class first, and only the parts' leaders meet, in as many rounds as are needed. Leaders that
resemble each other at all, far under the threshold, are of one cluster. Candidates are confirmed beside their leader,
whose text is sent once for ``FOLLOWERS`` of them. Clusters that the confirmed
stars leave in more than one component are settled exactly: the classes outside the cluster's largest component
are counted against all of its members in tiles of bounded size, and only links leave a tile, so no pairs
are emitted. Texts travel only for classes with a candidate. Components are DataFrame joins; nothing is
collected.

Defined cases: a null or blank text has an empty set, is linked with nothing and stays; fewer than
five words are one shingle; rows that are equal in id and text share their result; ids may be of any
type that has an order (a tie of copies goes to the smallest); rows with a null id are judged, but a component
is named by its smallest non-null id. An empty table gives an empty result. Extra columns
pass through; those named like a result (n_shingles, component_id, kept) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MIX_A, NUMBERS, ROW, U64, Stash, batch_rows, blocks, mix, row_keys, shingle_sets, text_bytes
from .components import connected

PERMUTATIONS, ROWS, BANDS, BITS = 128, 4, 32, 2
SIMILARITY = 75  # of 100
#: Estimates from which classes are of one cluster, a candidate is confirmed, and a row needs no other leader.
LIKE, ASK, SURE = 0.40, 0.55, 0.85
#: Rows of a bucket from which it is parted, and the share of classes that is looked at to find such buckets.
BUCKET, LOOK = 4096, 64
#: Followers that are confirmed beside one copy of their leader's text.
FOLLOWERS = 256
#: Shingles of a side of a tile: strays and members of a cluster are cut in so many, and two sides are one task's work.
TILE = 40_000
#: Rows of keys up to which they are sent to every task (at most 40 bytes each) instead of a shuffle.
SEND_ROWS = 1_000_000
_MULTIPLY = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * GOLDEN) | U64(1)
SIGNATURE = ("s0", "s1", "s2", "s3")


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows x 4) and band keys (rows x 32) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    minima = np.empty((PERMUTATIONS, len(sets)), U64)
    for i, a in enumerate(_MULTIPLY):
        h = flat * a
        h ^= h >> U64(32)
        minima[i] = np.minimum.reduceat(h, starts)
    planes = []
    for bit in range(BITS):
        packed = np.packbits(((minima >> U64(bit)) & U64(1)).astype(np.uint8).T, axis=1)
        planes.append(np.ascontiguousarray(packed).view(np.int64))
    keys = np.empty((len(sets), BANDS), np.int64)
    for band in range(BANDS):
        acc = np.full(len(sets), band + 1, U64)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            acc = mix((acc ^ row) * GOLDEN)
        keys[:, band] = acc.view(np.int64)
    return np.hstack(planes), keys


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row key, id, text) to (row key, id, set size, 128-bit set key, signature, band keys)."""
    for batch in batches:
        raw, off = text_bytes(batch.column(3))
        for lo, hi in blocks(off, 4 << 20):
            sets = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            at = np.flatnonzero(n)
            ka, kb = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            low, keys = np.zeros((len(sets), 4), np.int64), np.zeros((0, BANDS), np.int64)
            if full:
                flat, cuts = np.concatenate(full), np.cumsum(n[at])[:-1]
                starts, size = np.concatenate(([0], cuts)).astype(np.int64), n[at].astype(U64) * GOLDEN
                ka[at] = mix(np.bitwise_xor.reduceat(mix(flat ^ GOLDEN), starts) + size).view(np.int64)
                kb[at] = mix(np.add.reduceat(mix(flat ^ MIX_A), starts) ^ size).view(np.int64)
                low[at], keys = sketch(full)
            ends = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            same = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n), pa.array(ka), pa.array(kb), *(pa.array(np.ascontiguousarray(low[:, i])) for i in range(4)), bands], names=[*ROW, "id", "n", "ka", "kb", *SIGNATURE, "bands"])


_COUNT = np.array([bin(i).count("1") for i in range(65536)], np.uint8)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed rows; shapes broadcast over the last axis of 4."""
    off = (a[..., :2] ^ b[..., :2]) | (a[..., 2:] ^ b[..., 2:])
    off = np.ascontiguousarray(off)
    apart = _COUNT[off.view(np.uint16).reshape(*off.shape[:-1], 8)].sum(-1, dtype=np.int64)
    chance = 1 / 2**BITS
    return ((1 - apart / PERMUTATIONS) - chance) / (1 - chance)


class Bucket:
    """The leaders of a bucket, and what meets them."""

    def __init__(self) -> None:
        self.lead, self.sigs, self.group = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def feed(self, ids: np.ndarray, sigs: np.ndarray, out: list[tuple[np.ndarray, np.ndarray, bool]]) -> None:
        """Judge rows in their order; pairs (a, b, ask) go to ``out``.

        To be asked: each row and its first sure leader, or the likeliest one. Not to be asked, but of
        one cluster: a new leader and those earlier ones, one of each cluster, that it resembles at all."""
        n = len(ids)
        if n == 1 and not len(self.lead):
            self.lead, self.sigs, self.group = ids, sigs, np.zeros(1, np.int64)
            return
        met = [estimates(sigs[:, None], self.sigs[None])] if len(self.lead) else []
        first = np.full(n, -1)  # the first sure leader of each row
        if met:
            sure = met[0] >= SURE
            first = np.where(sure.any(1), sure.argmax(1), -1)
        i = 0
        while True:
            rest = np.flatnonzero(first[i:] < 0)
            if not len(rest):
                break
            i += int(rest[0])
            est = np.concatenate([m[i] for m in met]) if met else np.zeros(0)
            if len(est):
                best = int(est.argmax())
                if est[best] >= ASK:
                    out.append((self.lead[best : best + 1], ids[i : i + 1], True))
                like = np.flatnonzero(est >= LIKE)
                if len(like):
                    groups, at = np.unique(self.group[like], return_index=True)
                    out.append((self.lead[like[at]], np.full(len(at), ids[i]), False))
                    self.group[np.isin(self.group, groups)] = len(self.lead)
            own = len(self.lead)
            self.lead, self.sigs, self.group = np.append(self.lead, ids[i]), np.vstack([self.sigs, sigs[i : i + 1]]), np.append(self.group, own)
            col = estimates(sigs, sigs[i])
            met.append(col[:, None])
            later = np.arange(i + 1, n)
            first[later[(first[later] < 0) & (col[later] >= SURE)]] = own
            first[i] = own
            i += 1
        follow = self.lead[first] != ids
        out.append((self.lead[first][follow], ids[follow], True))


PAIRS = "a long, b long, ask boolean, key long, s0 long, s1 long, s2 long, s3 long"


def _rows(a: np.ndarray, b: np.ndarray | None, ask: np.ndarray, key: int, sigs: np.ndarray | None) -> pa.RecordBatch:
    """Pairs, or the leaders of a parted bucket (b is null)."""
    n = len(a)
    none = pa.nulls(n, pa.int64())
    kept = [none] * 5 if sigs is None else [pa.array(np.full(n, key)), *(pa.array(np.ascontiguousarray(sigs[:, k])) for k in range(4))]
    return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), pa.array(ask), *kept], names=["a", "b", "ask", "key", *SIGNATURE])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, part, c, signature, parted) to pairs, and of parted buckets the leaders."""
    bucket, key, parted = Bucket(), None, False
    for batch in batches:
        keys, part, ids, s0, s1, s2, s3 = (batch.column(i).to_numpy() for i in range(7))
        sigs, hot = np.stack([s0, s1, s2, s3], axis=1), batch.column(7).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1])) + 1
        lo, hi = np.concatenate(([0], cut)), np.append(cut, len(keys))
        # a row alone in its bucket meets nobody; the first and last bucket may go on in other batches
        some = np.flatnonzero((hi - lo > 1) | hot[lo])
        pairs: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for g in np.unique(np.concatenate(([0], some, [len(lo) - 1]))):
            this = (keys[lo[g]], part[lo[g]])
            if this != key:
                if parted and len(bucket.lead):
                    yield _rows(bucket.lead, None, np.zeros(len(bucket.lead), bool), key[0], bucket.sigs)
                bucket, key, parted = Bucket(), this, bool(hot[lo[g]])
            for k in range(lo[g], hi[g], 1024):
                bucket.feed(ids[k : min(k + 1024, hi[g])], sigs[k : min(k + 1024, hi[g])], pairs)
        if pairs:
            a, b = (np.concatenate([p[x] for p in pairs]) for x in (0, 1))
            yield _rows(a, b, np.concatenate([np.full(len(p[0]), p[2]) for p in pairs]), 0, None)
    if parted and len(bucket.lead):
        yield _rows(bucket.lead, None, np.zeros(len(bucket.lead), bool), key[0], bucket.sigs)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, part, c, text), the leader (c = a) first in each part: pairs whose full sets are similar enough."""
    held, lead, before = None, None, None
    for batch in batches:
        raw, off = text_bytes(batch.column(3))
        a, part, c = (batch.column(i).to_pylist() for i in range(3))
        follows = [x is None for x in c]
        left, right = [], []
        for lo, hi in blocks(off, 1 << 20):
            sets = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i, own in enumerate(sets, lo):
                if follows[i]:  # the leader's row
                    held, lead, before = (a[i], part[i]), own, None
                    continue
                if held != (a[i], part[i]) or c[i] == before:  # rows that are equal in every column sent theirs twice
                    continue
                before = c[i]
                both = len(np.intersect1d(lead, own, assume_unique=True))
                if both and 100 * both >= SIMILARITY * (len(lead) + len(own) - both):
                    left.append(a[i])
                    right.append(c[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the strays and the members of a tile (stray, c, root, text) that are of different components."""
    out: set[tuple[int, int]] = set()
    frame = frame.drop_duplicates(["stray", "c"]).sort_values(["stray", "c"])
    raw, off = text_bytes(pa.array(frame["text"].to_list(), pa.string()))
    sets = shingle_sets(raw, off)
    stray = frame["stray"].to_numpy()
    c, root = frame["c"].to_numpy(), frame["root"].to_numpy()
    member = np.flatnonzero(~stray)
    if len(member) and stray.any():
        size = np.array([len(sets[i]) for i in member])
        _, flat = np.unique(np.concatenate([sets[i] for i in member] + [sets[i] for i in np.flatnonzero(stray)]), return_inverse=True)
        mine, starts = flat[: size.sum()], np.concatenate(([0], np.cumsum(size)[:-1]))
        mark, at = np.zeros(int(flat.max()) + 1, np.int64), int(size.sum())
        for i in np.flatnonzero(stray):
            own = flat[at : at + len(sets[i])]
            at += len(sets[i])
            mark[own] = 1
            both = np.add.reduceat(mark[mine], starts)
            mark[own] = 0
            for j in member[(100 * both >= SIMILARITY * (size + len(own) - both)) & (root[member] != root[i])]:
                out.add((int(c[i]), int(c[j])))
    return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")


def _candidates(stash: Stash, reps: DataFrame) -> DataFrame:
    """(a, b, ask) of the classes that meet in a bucket."""
    todo = reps.select("c", *SIGNATURE, F.explode("bands").alias("key"))
    pieces, before, step = [], None, 0
    look = todo.where(F.pmod(F.xxhash64("c", F.lit(3)), F.lit(LOOK)) == 0).groupBy("key").agg((F.count("*") * LOOK).alias("rows"))
    while True:
        hot = stash.put(look.where(F.col("rows") >= BUCKET).select("key", F.ceil(F.col("rows") / BUCKET).alias("parts")), f"hot{step}")
        n, most = hot.agg(F.count("*"), F.max("parts")).first()
        if n and (before is None or most <= before / 2):
            salted = todo.join(F.broadcast(hot) if n <= SEND_ROWS else hot, "key", "left")
            part = F.pmod(F.xxhash64("c", F.lit(step)), F.coalesce("parts", F.lit(1)))
            salted = salted.select("key", part.alias("part"), "c", *SIGNATURE, F.col("parts").isNotNull().alias("parted"))
        else:  # none is hot, or their rows are so unlike that parts don't make them fewer
            n = 0
            salted = todo.select("key", F.lit(0).cast("long").alias("part"), "c", *SIGNATURE, F.lit(False).alias("parted"))
        with batch_rows(stash.spark, NUMBERS):
            made = stash.put(salted.repartition("key", "part").sortWithinPartitions("key", "part", "c").mapInArrow(_stars, PAIRS), f"met{step}")
        pieces.append(made.where("b is not null").select("a", "b", "ask"))
        if not n:
            break
        before, step = most, step + 1
        todo = made.where("b is null").select(F.col("a").alias("c"), *SIGNATURE, "key")
        look = todo.groupBy("key").agg(F.count("*").alias("rows"))
    pairs = pieces[0]
    for piece in pieces[1:]:
        pairs = pairs.union(piece)
    pairs = stash.put(pairs.groupBy("a", "b").agg(F.max("ask").alias("ask")), "pairs")
    stash.drop(*(f"{x}{k}" for x in ("hot", "met") for k in range(step + 1)))
    return pairs


def _sent(stash: Stash, texts: DataFrame, reps: DataFrame, to: DataFrame, name: str) -> DataFrame:
    """``to`` (c and other columns) with the classes' texts."""
    to = stash.put(to.join(reps.select("c", *ROW), "c"), f"{name}-to")
    few = to.count() <= SEND_ROWS
    return stash.put(texts.join(F.broadcast(to) if few else to, list(ROW)).drop(*ROW), f"{name}-texts")


def _links(stash: Stash, texts: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (leader a, follower b) whose full sets are linked."""
    parts = stash.put(pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")), "parts")
    follow = pairs.join(parts, "a").select(F.col("b").alias("c"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("lead"))
    lead = parts.select(F.col("a").alias("c"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    rows = _sent(stash, texts, reps, follow.union(lead), "stars")
    rows = rows.select("a", "part", F.when(~F.col("lead"), F.col("c")).alias("c"), "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("c"))
    return stash.put(rows.mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _settled(stash: Stash, texts: DataFrame, reps: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Links that the stars have left open: between classes of one cluster that are not one component yet."""
    roots = connected(stash, links, "first")
    loose = connected(stash, pairs.select("a", "b"), "loose").select(F.col("node").alias("c"), F.col("root").alias("cluster"))
    loose = loose.unionByName(loose.select(F.col("cluster").alias("c"), "cluster").distinct())
    loose = stash.put(loose.join(roots, F.col("c") == F.col("node"), "left").select("cluster", "c", F.coalesce("root", "c").alias("root")), "clusters")
    sized = stash.put(loose.join(reps.select("c", "n"), "c"), "sized")
    each = stash.put(sized.groupBy("cluster", "root").agg(F.sum("n").alias("n")), "each")
    open_ = each.groupBy("cluster").agg(F.count("*").alias("k"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("k > 1")
    open_ = open_.select("cluster", F.col("most.root").alias("most"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil((F.col("n") - F.col("most.n")) / TILE).cast("int").alias("sides"))
    open_ = stash.put(open_, "open")
    members = stash.put(sized.join(open_, "cluster"), "members")
    # each member goes to the sides of the strays, each stray to the tiles of the members; sides and tiles are of bounded size
    tile, side = (F.pmod(F.xxhash64("c", F.lit(k)), F.col(x)).cast("int") for k, x in ((1, "tiles"), (2, "sides")))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    to = members.select("c", "cluster", "root", tile.alias("i"), every("sides").alias("j"), F.lit(False).alias("stray"))
    to = to.unionByName(members.where("root <> most").select("c", "cluster", "root", every("tiles").alias("i"), side.alias("j"), F.lit(True).alias("stray")))
    tiles = _sent(stash, texts, reps, to, "tiles").select("cluster", "i", "j", "stray", "c", "root", "text")
    return stash.put(tiles.groupBy("cluster", "i", "j").applyInPandas(_across, "a long, b long"), "second")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept (see the module's text)."""
    stash = Stash(docs.sparkSession, "minhash")
    docs = docs.drop(*({"n_shingles", "component_id", "kept"} - {id_col, text_col}))
    keys = row_keys(id_col, text_col)
    texts = docs.select(*(k.alias(c) for c, k in keys.items()), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*(k.alias(c) for c, k in keys.items()), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = stash.put(rows.mapInArrow(_scan, f"{ROW[0]} long, {ROW[1]} long, id {kind}, n long, ka long, kb long, s0 long, s1 long, s2 long, s3 long, bands array<long>"), "scan")
    some = scan.where("n > 0")
    # numbered as written: the number of a class is its name
    classes = some.groupBy("ka", "kb").agg(F.min("id").alias("cid"), F.min(ROW[0]).alias("rep"))
    classes = stash.put(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    reps = some.join(classes.select("c", "ka", "kb", F.col("rep").alias(ROW[0])), ["ka", "kb", ROW[0]])
    # of repeated rows one
    reps = stash.put(reps.select("c", *ROW, "n", *SIGNATURE, "bands").dropDuplicates(["c"]), "reps")
    pairs = _candidates(stash, reps)
    links = _links(stash, texts, reps, pairs.where("ask").select("a", "b"))
    second = _settled(stash, texts, reps, pairs, links)
    roots = connected(stash, links.union(second), "all")
    named = stash.put(classes.join(roots, F.col("c") == F.col("node"), "left").select("ka", "kb", "cid", F.coalesce("root", "c").alias("root")), "named")
    least = stash.put(named.groupBy("root").agg(F.min("cid").alias("component_id")), "least")
    named = stash.put(named.join(least, "root").select("ka", "kb", "component_id"), "components")
    # empty sets are their own component
    judged = scan.where("n > 0").select(*ROW, "id", "n", "ka", "kb").join(named, ["ka", "kb"]).select(*ROW, "id", "n", "component_id")
    judged = judged.unionByName(scan.where("n = 0").select(*ROW, "id", "n", F.col("id").alias("component_id"))).dropDuplicates(list(ROW))
    judged = stash.put(judged.select(*ROW, F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "judged")
    stash.keep("judged")
    return docs.withColumns(keys).join(judged, list(ROW)).drop(*ROW)
