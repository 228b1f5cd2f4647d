"""First-wins duplicates: by key, by fuzzy title and by word sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import windows
from tarnwick.operators.similar import DICTIONARY, SEND_ROWS, Similar, few, numbers
from tarnwick.session import Parked, checkpointed


def first_of(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id) dropped by a sequential first-wins pass: b goes if a kept, earlier a resembles it.

    Resolved in rounds instead of in order: rows without an undecided or kept earlier neighbour are
    kept, later neighbours of kept rows go, until none is open. Each round is joins by id."""
    open_ = checkpointed(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    dropped = None
    while open_.head(1):
        later = open_.select(F.col("b").alias("a")).distinct()
        kept = open_.select("a").distinct().join(later, "a", "left_anti")
        gone = checkpointed(open_.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        left = open_.join(kept, "a", "left_anti").join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti")
        open_ = checkpointed(left)
    return dropped.distinct() if dropped is not None else pairs.select(F.col(b).alias("id")).limit(0)


def _named(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both) of pairs (x, y, both) of row numbers, a < b."""
    names = sets.select("c", "id")
    full = pairs.join(names.select(F.col("c").alias("x"), F.col("id").alias("i")), "x").join(names.select(F.col("c").alias("y"), F.col("id").alias("j")), "y")
    return full.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "both")


def similar_sets(df: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """(a, b, both) of rows a < b whose word sets have a Jaccard similarity of ``threshold`` or more.

    Exact (see ``similar``): words are 64-bit hashes, the rarest of a set are joined, and what places and counts by cell leave is counted on the sets."""
    join = Similar(df.sparkSession, threshold)
    sets = join.stored(df.select(F.col(key).alias("id"), numbers(words).alias("w")))
    pairs = join.pairs(sets)
    join.park.keep("sets", "pairs")
    return _named(pairs, sets)


def first_wins_sets(df: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """Rows (id) dropped by a first-wins pass over word sets.

    Later rows of an equal set always go: whatever keeps or drops the first drops them. So a group of
    copies is one row in the similarity join and emits no pairs."""
    join, _, gone, copies = _sets_passed(df, key, words, threshold)
    join.park.keep("copies")
    return gone.unionByName(copies)


def first_wins_kept(df: DataFrame, key: str, words: str, threshold: float, *also: str) -> DataFrame:
    """The rows (id and columns of ``df``) that such a pass keeps, from the table that it stores anyway: ``df`` is worked out once."""
    join, sets, gone, copies = _sets_passed(df, key, words, threshold, *also)
    join.park.keep("sets", "copies")
    return sets.select("id", *also).join(few(checkpointed(gone.unionByName(copies))), "id", "left_anti")


def _sets_passed(df: DataFrame, key: str, words: str, threshold: float, *also: str) -> tuple[Similar, DataFrame, DataFrame, DataFrame]:
    """The join, its stored sets, and what goes: rows like kept ones and rows of an earlier equal set."""
    join = Similar(df.sparkSession, threshold)
    sets = join.stored(df.select(F.col(key).alias("id"), F.sort_array(numbers(words)).alias("w"), *also))
    named = sets.select("id", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"))
    firsts = named.groupBy("h", "g").agg(F.min("id").alias("id")).select("id")
    copies = join.park.put(named.select("id").join(firsts, "id", "left_anti"), "copies")
    each = sets.select("id", "c", "w")
    # without the broadcast the sets are shuffled: once, as the join reads them some times
    once = each.join(F.broadcast(copies), "id", "left_anti") if copies.count() <= SEND_ROWS else join.park.put(each.join(copies, "id", "left_anti"), "once", **DICTIONARY)
    return join, sets, first_wins(_named(join.pairs(once), sets)), copies


def fuzzy_titles(spelled: DataFrame, least: float = 97.0) -> DataFrame:
    """(g, ta, tb, score), ta < tb, of the distinct titles (g, t) of one group whose similarity is at least ``least`` percent.

    Such titles are equal but for a few insertions and deletions, so only those are compared that share a window of
    characters which stands in all titles so near (see ``windows``), once for each spelling. Levenshtein (never more than
    insertions plus deletions) is cut off at the bound before the exact subsequence."""
    share = 1 - least / 100
    if not 0 <= share < 1 / 3:
        raise ValueError("least has to be over 66.7 percent, and 100 at most")
    long = spelled.where(F.length("t") >= windows.shortest(share)) if share else spelled.limit(0)
    strings = checkpointed(long.select(F.monotonically_increasing_id().alias("c"), "g", "t"))
    x, y = (strings.select(F.col("c").alias(c), F.col("g").alias(f"g{c}"), F.col("t").alias(f"t{c}")) for c in ("x", "y"))
    met = (windows.candidates(strings, share) if share else strings.select(F.col("c").alias("x"), F.col("c").alias("y"))).join(x, "x").join(y, "y").where("gx = gy")
    bound = F.floor(share * (F.length("tx") + F.length("ty")) + 1e-9).cast("int")
    met = met.select(F.col("gx").alias("g"), F.least("tx", "ty").alias("ta"), F.greatest("tx", "ty").alias("tb"), bound.alias("bound")).where("levenshtein(ta, tb, bound) >= 0")
    # stored, as the planner would else ask for the dear ratio before the cheap bounds, for every pair of the join
    met = checkpointed(met.drop("bound"))
    return met.withColumn("score", F.round(T.ratio(F.col("ta"), F.col("tb")), 6)).where(F.col("score") >= least)


def fuzzy_pairs(df: DataFrame, group: str, key: str, title: str, least: float = 97.0) -> DataFrame:
    """(a, b, score) of all rows a < b of one group whose titles are alike; equal titles make all their pairs."""
    t = checkpointed(df.where(F.col(title) != "").select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(title).alias("t")))
    spelled = t.select("g", "t").distinct()
    alike = fuzzy_titles(spelled, least)
    alike = alike.unionByName(alike.select("g", F.col("tb").alias("ta"), F.col("ta").alias("tb"), "score")).unionByName(spelled.select("g", F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(100.0).alias("score")))
    left, right = t.select("g", F.col("k").alias("a"), F.col("t").alias("ta")), t.select("g", F.col("k").alias("b"), F.col("t").alias("tb"))
    return left.join(alike, ["g", "ta"]).join(right, ["g", "tb"]).where("a < b").select("a", "b", "score")


def first_wins_titles(rows: DataFrame, least: float = 97.0) -> DataFrame:
    """Rows (id, g) kept of (id, u, g, t) by a sequential pass: a row goes if an earlier kept one has its url u or, in its group g, a title like its t.

    No pair of rows is made. A url and a title are classes of which one row at most is kept, and only distinct titles
    are compared. In each round a row is kept that is the first open one of its url, of its title and of all titles
    like it; then all open rows of those classes go. So a round is sums by class and joins to them, and copies by the
    hundred thousand go in one. Rows of a null or empty title are held to their url alone, those of a null url to their title."""
    park = Parked(rows.sparkSession, "titles")
    open_ = park.put(rows.select("id", "u", "g", F.when(F.col("t") != "", F.col("t")).alias("t")), "rows")
    half = fuzzy_titles(open_.where("t is not null and g is not null").select("g", "t").distinct(), least).select("g", "ta", "tb")
    alike = checkpointed(half.unionByName(half.select("g", F.col("tb").alias("ta"), F.col("ta").alias("tb"))))
    kept = None
    while open_.head(1):
        url, title = open_.groupBy("u").agg(F.min("id").alias("mu")), open_.where("t is not null").groupBy("g", "t").agg(F.min("id").alias("mt"))
        near = alike.join(title.withColumnRenamed("t", "tb"), ["g", "tb"]).groupBy("g", F.col("ta").alias("t")).agg(F.min("mt").alias("mn"))
        told = open_.join(url, "u", "left").join(title, ["g", "t"], "left").join(near, ["g", "t"], "left")
        first = F.coalesce(F.col("id") <= F.col("mu"), F.lit(True)) & F.coalesce(F.col("id") <= F.col("mt"), F.lit(True)) & F.coalesce(F.col("id") < F.col("mn"), F.lit(True))
        new = checkpointed(told.where(first).select("id", "u", "g", "t"))
        kept = new.select("id", "g") if kept is None else kept.unionByName(new.select("id", "g"))
        taken = new.where("t is not null and g is not null").select("g", "t")
        taken = taken.unionByName(taken.withColumnRenamed("t", "ta").join(alike, ["g", "ta"]).select("g", F.col("tb").alias("t"))).distinct()
        rest = open_.join(new.select("id"), "id", "left_anti").join(new.select("u").distinct(), "u", "left_anti").join(taken, ["g", "t"], "left_anti")
        open_ = checkpointed(rest.select("id", "u", "g", "t"))
    park.keep()
    return kept if kept is not None else rows.select("id", "g").limit(0)


def bands(rows: int = 128, threshold: float = 0.75) -> tuple[int, int]:
    """(bands, rows) that weigh false positives and negatives alike at a threshold."""
    best = (math.inf, 1, 1)
    for b in range(1, rows + 1):
        for r in range(1, rows // b + 1):
            p = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            grid = [i / 200 for i in range(201)]
            cost = sum(p(s) for s in grid if s < threshold) + sum(1 - p(s) for s in grid if s >= threshold)
            best = min(best, (cost, b, r))
    return best[1], best[2]


def minhash(df: DataFrame, key: str, words: Column, permutations: int = 128, block: int = 16) -> DataFrame:
    """(key, s): minima of linear hashes of md5 word values, summed map-side in generated code.

    A word is hashed once; its row is then repeated for each block of permutations, so that the
    aggregation's code stays small enough to be compiled. A row without words has nulls."""
    prime = 4294967291
    each = df.select(key, F.explode_outer(words).alias("w")).select(key, F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long").alias("h"))
    each = each.select(key, "h", F.explode(F.array(*[F.lit(i) for i in range(0, permutations, block)])).alias("i"))
    of = lambda j: F.pmod(F.col("h") * ((F.col("i") + j) * 2 + 1) + (F.col("i") + j) * 7919 + 13, F.lit(prime))
    parts = each.groupBy(key, "i").agg(F.array(*[F.min(of(j)) for j in range(block)]).alias("m"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return rows.select(key, F.flatten(F.transform("p", lambda x: x["m"])).alias("s"))
