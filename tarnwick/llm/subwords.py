"""A quality classifier of supervised subword embeddings.

A document is the bag of its words (runs without white space, as they are written), their character n-grams of 3 to 5
with marks for a word's ends, and its pairs of neighbouring words, all hashed to ``BUCKETS`` vectors. The
vectors are averaged, a softmax over the two classes stands on the average, and all is learnt by stochastic
gradient descent in numpy. A pair of one word with itself is named by the repetition, whatever the word.

Training runs on ``SHARDS`` shares of the stored sample, dealt by id hash: tasks descend document by document from the same model,
which is their mean of the round before, and the step falls with the rounds. A share is streamed, so a task needs
the model (4 MB) and one batch. For scoring the model folds to one number a bucket, as both
averaging and the difference of the two classes are linear.

The fit uses at most ``SAMPLE`` labelled rows, those of smallest id hash; each word and each whole text of them is used, and
scoring covers all rows. Labels, language, source and id are no inputs of a score.

Defined cases: texts that are null or have no words get the score of the bias alone. Null labels and labels other than 0 and 1
are ignored, of several labels of a row the largest counts; a null id has no label. Where the sample's documents don't have labels of both kinds, every score is the
share of label 1, or 0. Repeated rows count each in the sample and get equal scores. An empty table gives an empty result. Extra
columns pass through; those named score or predicted are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MIX_A, MIX_B, U64, Stash, mix, small_batches

#: Labelled rows in the fit at most.
SAMPLE = 8_000
#: Hash buckets, width of the vectors, lengths of character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (3, 4, 5)
#: Shares of the sample at most, rounds, first step, and documents that are looked at in all at least (small samples again and again).
SHARDS, ROUNDS, STEP, LOOKS = 4, 6, 0.5, 24_000
#: Score from which a document is good.
GOOD = 0.3
#: Words that a task remembers, and characters of the texts that it works at a time.
REMEMBERED, AT_ONCE = 200_000, 500_000
_REPEAT = int(mix(np.array([1], U64))[0] % U64(BUCKETS))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a null id has none and isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, and the buckets of all words' own features with each word's first (one more than words)."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    long = np.fromiter(map(len, marked), np.int64, len(words))
    end = np.cumsum(long)
    begin = end - long
    word = np.repeat(np.arange(len(words)), long)
    place = (np.arange(len(points)) - begin[word]).astype(U64)
    hashes = mix(np.add.reduceat(mix(points + place * GOLDEN), begin))
    found, owner = [hashes], [np.arange(len(words))]
    for n in GRAMS:
        if len(points) < n:
            continue
        at = np.flatnonzero(np.arange(len(points) - n + 1) + n <= end[word[: len(points) - n + 1]])
        h = np.full(len(at), n, U64)
        for k in range(n):
            h = (h + points[at + k]) * MIX_A + GOLDEN
        found.append(mix(h))
        owner.append(word[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return hashes, (np.concatenate(found)[order] % U64(BUCKETS)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words) + 1))


def pair_buckets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words of a document, from the words' hashes in order, and each document's first."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.ones(len(hashes) - 1, bool)
    cuts = off[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(hashes))] - 1] = False
    b = (mix(hashes[:-1] * MIX_B + hashes[1:]) % U64(BUCKETS)).astype(np.int64)
    b[hashes[:-1] == hashes[1:]] = _REPEAT
    at = np.flatnonzero(inside)
    return b[at], np.searchsorted(at, off)


class Words:
    """Words by number, remembered from batch to batch; ``fresh`` takes the words that are new."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.known = 0

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, long, out = self.ids, [], []
        for t in texts:
            own = t.split()
            long.append(len(own))
            out += [ids.setdefault(w, len(ids)) for w in own]
        return np.array(out, np.int64), np.concatenate(([0], np.cumsum(long, dtype=np.int64)))

    def fresh(self) -> list[str]:
        words = list(self.ids)[self.known :]
        self.known = len(self.ids)
        return words


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, about AT_ONCE characters at a time; a longer text is alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t or "")
        size += len(t or "")
    if part:
        yield part


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and how often each occurs."""
    words = Words()
    ids, off = words.number(texts)
    if not len(ids):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    hashes, buckets, first = word_features(words.fresh())
    pairs, pair_off = pair_buckets(hashes[ids], off)
    out = []
    for d in range(len(texts)):
        own, times = np.unique(ids[off[d] : off[d + 1]], return_counts=True)
        long = first[own + 1] - first[own]
        at = np.arange(long.sum()) + np.repeat(first[own] - (np.cumsum(long) - long), long)
        counts = np.bincount(buckets[at], np.repeat(times, long), BUCKETS) + np.bincount(pairs[pair_off[d] : pair_off[d + 1]], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        out.append((used, counts[used].astype(np.int64)))
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in chunks(batch.column("text").to_pylist()):
            found = bags(part)
            rows = batch.slice(at, len(part))
            at += len(part)
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32()))], names=["label", "buckets", "times"])


def start(width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The first model: small vectors from a fixed stream, and a softmax of zeros with the biases in the last column."""
    return (np.random.default_rng(7).uniform(-1 / width, 1 / width, (BUCKETS, width))).astype(np.float32), np.zeros((2, width + 1), np.float32)


def descend(vectors: np.ndarray, soft: np.ndarray, buckets: np.ndarray, times: np.ndarray, label: int, step: float) -> None:
    """One document's step, in place. The mean shares a vector's step among the buckets; their root is put back."""
    share = times.astype(np.float32) / max(1, times.sum())
    own = vectors[buckets]
    mean = np.append(share @ own, np.float32(1))
    z = soft @ mean
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    back = p @ soft[:, :-1]
    soft -= step * np.outer(p, mean)
    vectors[buckets] = own - step * np.outer(share, back) * len(buckets) ** 0.5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model {weight of each bucket, bias} from labelled rows that are not held out."""
    spark = docs.sparkSession
    stash = Stash(spark, "subwords")
    key = F.col(id_col).cast("string")
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(key.alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where("label in (0, 1)")
    known = stash.put(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "known")
    place = F.xxhash64("_id", F.lit(1))
    rows = docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id")  # at most ``sample`` rows of two numbers
    rows = rows.select(place.alias("place"), "label", "text").repartition(4 * SHARDS, "place").sortWithinPartitions("place", "text")
    rows = stash.put(rows.select("label", "text"), "rows")
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        stash.keep()
        return {"weights": None, "bias": 40.0 if n and good == n else -40.0}
    found = stash.put(rows.mapInArrow(_bags, "label int, buckets array<int>, times array<int>"), "bags")
    vectors, soft = start()
    passes = -(-LOOKS // (n * ROUNDS))  # over 1 only for samples of LOOKS / ROUNDS documents or less

    def round_of(vectors: np.ndarray, soft: np.ndarray, step: float):
        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, s, again = vectors.copy(), soft.copy(), []
            for batch in batches:
                b, t, y = batch.column("buckets"), batch.column("times"), batch.column("label").to_pylist()
                for k in range(batch.num_rows):
                    if len(b[k]):
                        descend(v, s, b[k].values.to_numpy(), t[k].values.to_numpy(), y[k], step)
                        if passes > 1:
                            again.append((b[k].values.to_numpy(), t[k].values.to_numpy(), y[k]))
            for _ in range(passes - 1):
                for one in again:
                    descend(v, s, *one, step)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["v", "s"])

        return share

    for r in range(ROUNDS):
        # SHARDS models at most; the stored bags are read where they lie, without a shuffle
        parts = found.coalesce(SHARDS).mapInArrow(round_of(vectors, soft, STEP * (1 - r / ROUNDS)), "v binary, s binary").collect()
        vectors = np.mean([np.frombuffer(p.v, np.float32).reshape(vectors.shape) for p in parts], 0, dtype=np.float32)
        soft = np.mean([np.frombuffer(p.s, np.float32).reshape(soft.shape) for p in parts], 0, dtype=np.float32)
    stash.keep()
    apart = soft[1] - soft[0]
    return {"weights": vectors @ apart[:-1], "bias": float(apart[-1])}


def _logits(texts: list[str], words: Words, sums: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The difference of the two classes for each text, without the bias. ``sums``: of the known words (hash, weights, features)."""
    ids, off = words.number(texts)
    if not len(ids):
        return np.zeros(len(texts))
    if new := words.fresh():
        hashes, buckets, first = word_features(new)
        for k, more in enumerate((hashes, np.add.reduceat(weights[buckets], first[:-1]), np.diff(first))):
            sums[k] = np.concatenate((sums[k], more))
    pairs, pair_off = pair_buckets(sums[0][ids], off)
    whole = lambda values, at: np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=float)))[at])
    total = whole(sums[1][ids], off) + whole(weights[pairs], pair_off)
    count = whole(sums[2][ids], off) + np.diff(pair_off)
    return total / np.maximum(count, 1)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; other columns pass through."""
    small_batches(docs.sparkSession)
    weights, bias = model["weights"], model["bias"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh = lambda: (Words(), [np.zeros(0, U64), np.zeros(0), np.zeros(0, np.int64)])
        words, sums = fresh()
        for each in batches:
            parts = []
            for texts in chunks(each.tolist()):
                if len(words.ids) > REMEMBERED:
                    words, sums = fresh()
                parts.append(_logits(texts, words, sums, weights) if weights is not None else np.zeros(len(texts)))
            z = np.concatenate([*parts, np.zeros(0)]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))
