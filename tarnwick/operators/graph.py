"""Breadth-first searches over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import checkpointed


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth, parent) reachable from ``seeds`` (node) in at most ``depth`` steps along (src, dst).

    One frontier join and one anti-join a level; the parent is the smallest that reaches a node first. The edges
    are stored once, not made anew at each level."""
    edges = checkpointed(edges.select("src", "dst"))
    seen = frontier = checkpointed(seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent")).distinct())
    for level in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = checkpointed(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "parent"))
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def trees(edges: DataFrame, pages: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, key, target, depth, rank, parent): the breadth-first tree of each seed, held to its scope and budget.

    ``edges`` (page, pos, target, key, scope) are a page's links in its order, ``pages`` (key, page) the page that
    stands for a key, ``seeds`` (seed, page, target, key, scope, budget) the roots. The search of a seed visits pages in the
    order in which they were found and their links by place; a link counts if its scope is the seed's (null: any) and its
    key is new to the seed, until ``budget`` rows, root included, are found or ``depth`` steps are gone. All seeds step together, one
    frontier join a level; what a seed has left of its budget goes with its frontier, and a seed without any drops out.
    Links of one page and place are taken by key. A budget under 1 or null gives no rows."""
    edges, pages = checkpointed(edges.select("page", "pos", "target", "key", "scope")), checkpointed(pages.select("key", "page"))
    cols = ("seed", "key", "target", "depth", "rank", "parent")
    roots = seeds.where("budget >= 1").withColumns({"depth": F.lit(0), "rank": F.lit(1), "parent": F.lit(None).cast(dict(seeds.dtypes)["target"])})
    level = checkpointed(roots.select(*cols, "page", "scope", (F.col("budget") - 1).alias("left")))
    found, most = [level.select(*cols)], level.agg(F.max("left")).first()[0]
    for d in range(1, depth + 1):
        frontier = level.where("page is not null and left > 0").select("seed", "page", F.col("rank").alias("r"), F.col("target").alias("from"), F.col("scope").alias("home"), "left")
        links = frontier.join(edges, "page").where("home is null or scope = home")
        # of each key the first link; the place in the search is all that the choice hangs on
        first = links.groupBy("seed", "key").agg(F.min(F.struct("r", "pos", "target", "from", "home")).alias("x"), F.first("left").alias("left"))
        seen = found[0].select("seed", "key")
        for each in found[1:]:
            seen = seen.unionByName(each.select("seed", "key"))
        new = first.join(seen, ["seed", "key"], "left_anti")
        place = Window.partitionBy("seed").orderBy("x.r", "x.pos", "key")
        new = new.withColumn("k", F.row_number().over(place)).where((F.col("k") <= most) & (F.col("k") <= F.col("left")))
        before = level.groupBy("seed").agg(F.max("rank").alias("last"))  # the frontier's own ranks are a seed's last
        new = new.join(before, "seed").join(pages, "key", "left")
        level = checkpointed(new.select("seed", "key", "x.target", F.lit(d).alias("depth"), (F.col("last") + F.col("k")).cast("int").alias("rank"), F.col("x.from").alias("parent"), "page", F.col("x.home").alias("scope"), (F.col("left") - F.max("k").over(Window.partitionBy("seed"))).alias("left")))
        if not level.head(1):
            break
        found.append(level.select(*cols))
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out
