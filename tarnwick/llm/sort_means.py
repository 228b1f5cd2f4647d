"""Clusters of integer vectors by sort-means: exact k-means whose assignment looks at few centroids.

Each round, the other centroids of every centroid are ordered by their distance from it. A vector
starts at the centroid that it was assigned to before, at distance d, and looks at the others in that order; by
the triangle inequality none that lies strictly beyond 2 d from the old centroid can be nearer, nor as near, so the look
ends there. Distances are integers, so ties are exact and go to the smaller number. The centroids of a
round (a few KB) are sent to the tasks; tasks return sums, which Spark adds up as decimals, and the new
centroids are the exact floors of the means. A round's assignments are stored, so a lost executor costs no round.

Defined cases: vectors that are null, of another length, or with a component that is null, not finite or
of ``LIMIT`` and more in absolute value (whose squared distances would not fit a long) are left out. Ids may be of any type, null or repeated:
each row is a vector of its own, and a null id is hashed as empty text. Equal hashes stand by their
components. With fewer vectors than ``k`` there are fewer centroids, equal centroids keep their numbers and the smallest takes all; an
empty table gives an empty result. Sums of distances beyond a long end at its largest value. Of other columns none is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS, Stash, batch_rows

#: Components are this many times the given ones, rounded down; given ones of LIMIT and more are left out.
SCALE, LIMIT = 64, 2.0**20
LONGEST = 2**63 - 1


def integers(table: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, v) of the rows that have a vector, as integers."""
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(v) == size) & F.forall(v, lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False))), F.lit(False))
    return table.select(F.col(id_col).alias("id"), F.when(good, F.transform(v, lambda x: F.floor(x * SCALE).cast("int"))).alias("v")).where("v IS NOT NULL")


def seeds(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of ``1:`` and the id."""
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((v - c) ** 2).sum(-1)


def assign(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and its squared distance, and how many distances were taken.

    ``before``: where each vector's look begins; any start gives the same result."""
    cluster, distance, taken = before.copy(), np.zeros(len(v), np.int64), 0
    between = squared(centroids[:, None], centroids[None])
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        own = squared(v[rows], centroids[a])
        others = np.argsort(between[a], kind="stable")
        others = others[others != a]
        reach = np.searchsorted(between[a][others], 4 * own, side="right")  # as far as twice the distance, squared
        best, who = own.copy(), np.full(len(rows), a)
        for j, c in enumerate(others):
            look = np.flatnonzero(reach > j)
            if not len(look):
                break
            d = squared(v[rows[look]], centroids[c])
            better = (d < best[look]) | ((d == best[look]) & (c < who[look]))
            best[look[better]], who[look[better]] = d[better], c
            taken += len(look)
        cluster[rows], distance[rows], taken = who, best, taken + len(rows)
    return cluster, distance, taken


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), -1)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = assign(matrix(batch.column(1)), batch.column(2).to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "v", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v", "cluster").mapInArrow(run, f"id {kind}, v array<int>, cluster int, distance long")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: (cluster, n, component sums)."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        v, cluster = matrix(batch.column(0)), batch.column(1).to_numpy()
        for c in np.unique(cluster).tolist():
            rows = v[cluster == c]
            sums[c] = sums.get(c, 0) + rows.sum(0)
            counts[c] = counts.get(c, 0) + len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([counts[c] for c in sums], pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids at the floors of their vectors' means."""
    parts = state.select("v", "cluster").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in each.collect():  # one number for each component of each centroid
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64) -> DataFrame:
    """Each vector's id, cluster, squared distance, cluster_inertia, inertia and centroid_sha256 after ``rounds`` moves of the centroids."""
    spark = table.sparkSession
    stash = Stash(spark, "sortmeans")
    state = stash.put(integers(table, id_col, vector_col, size).withColumn("cluster", F.lit(0)), "round0")
    centroids = np.array(seeds(state, k), np.int64)
    with batch_rows(spark, NUMBERS):
        for r in range(rounds + 1 if len(centroids) else 0):
            state = stash.put(_assigned(state, centroids), f"round{r + 1}")
            stash.drop(f"round{r}")
            if r < rounds:
                centroids = _moved(state, centroids)
    if not len(centroids):
        state = state.withColumn("distance", F.lit(0).cast("long"))
    # one row for each centroid
    inertia = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(inertia.values()), LONGEST)
    known = [(c, min(inertia.get(c, 0), LONGEST), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
