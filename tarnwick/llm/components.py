"""Connected components of a link table, wholly as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def connected(stash: Stash, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b), where root is the component's smallest node.

    Alternates large-star and small-star steps until no link moves. Each step only groups links by
    a node, so the rows of a hot node are summed map-side (the minimum) and joined under AQE's skew
    handling; nothing is collected but a count and a checksum."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stash.put(edges, f"{name}0")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark, step = print_of(edges), 0
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours are written first: joins of plain shuffles can be split at a hot node
        low = stash.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low{step}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash.put(large.where("u <> v").distinct(), f"{name}-large{step}")
        low = stash.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least{step}")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        step += 1
        edges = stash.put(small.where("u <> v").distinct(), f"{name}{step}")
        stash.drop(*(f"{name}{x}{step - 1}" for x in ("", "-low", "-large", "-least")))
        new = print_of(edges)
        if new == mark:
            break
        mark = new
    # at rest every node points at its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
