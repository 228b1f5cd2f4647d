"""Scoring, top-k, diversification and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.session import checkpointed

K1, B = 1.2, 0.75
NOISE = 0.05


def bm25(docs: DataFrame, terms: list[str], text: str = "text", decimals: int = 6) -> DataFrame:
    """``docs`` with score in [0, 1): BM25 over whole texts, squashed by s / (1 + s).

    Texts are parted into words once: the rows are stored with their term counts, from which the
    corpus statistics (one row) and the scores are taken. No token is exploded or shuffled."""
    words = docs.withColumn("_w", T.words(F.col(text)))
    return bm25_of(checkpointed(words.withColumns(term_counts(terms, "_w")).drop("_w")), terms, decimals)


def term_counts(terms: list[str], words: str) -> dict[str, Column]:
    """How often each term stands among the words of a row (_t0 ...), and how many words there are (_len)."""
    return {f"_t{i}": F.size(F.filter(words, _is(t))) for i, t in enumerate(terms)} | {"_len": F.size(words)}


def bm25_of(counted: DataFrame, terms: list[str], decimals: int = 6) -> DataFrame:
    """``counted`` with its score in place of its ``term_counts``. It is read twice: it has to be stored."""
    tf = [f"_t{i}" for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(n) > 0).alias(f"_d{n}") for n in tf])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for n in tf:
        idf = F.log(1 + (F.col("_n") - F.col(f"_d{n}") + 0.5) / (F.col(f"_d{n}") + 0.5))
        score = score + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return joined.withColumn("score", F.round(score / (1 + score), decimals)).drop("_len", "_n", "_avg", *tf, *[f"_d{n}" for n in tf])


def _is(term: str):
    return lambda w: w == F.lit(term)


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with their rank; planned as a grouped limit before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diversify(df: DataFrame, domain: str, most: int | None, *order: Column) -> DataFrame:
    """``df`` with spread: round-robin over domains in the order of their best rows (by ``order``, ascending).

    Nothing is ranked globally. A row of round k comes after k - 1 rows of its own domain, so if only
    the first ``most`` rows are asked for, later rounds are cut off before the shuffle."""
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    if most is None:  # whole domains may be large: no window holds one
        rounds = ranked_within(keyed, domain, F.col("_key"), name="_round")
    else:
        rounds = keyed.withColumn("_round", F.row_number().over(Window.partitionBy(domain).orderBy("_key"))).where(F.col("_round") <= most)
    firsts = rounds.where("_round = 1").select(F.col(domain).alias("_d"), F.col("_key").alias("_first"))
    rounds = rounds.join(firsts, F.col(domain).eqNullSafe(F.col("_d")))
    return rounds.withColumn("spread", F.struct("_round", "_first")).drop("_key", "_round", "_first", "_d")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in the whole order, without a window of one task.

    Rows are dealt by ranges of the order, numbered in each range, and the ranges' counts (a row for
    each partition) give the offsets. Cut from its lineage, so that ranges and counts agree."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the partition stands in the upper 31 bits
    marked = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = marked.withColumn("_part", part).join(F.broadcast(before.drop("n")), "_part")
    return out.withColumn(name, (F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_before")


def ranked_within(df: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, without a window of a group's rows.

    Rows are dealt by ranges of group and order, so a group of half of all rows lies in many partitions; each run of a
    group in a partition is counted, and the runs before it (a row for each partition and group) give its offset. Nulls are a group; ties need an order that ends in a key."""
    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    marked = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = marked.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).drop("n")
    out = marked.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_g", "_p", "_first", "_before")


def final_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Dense output ranks over a result that is small by then (after a limit)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
