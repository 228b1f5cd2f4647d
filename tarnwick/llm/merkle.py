"""A Merkle manifest of a table: a leaf for each row, a binary tree for each group, one root over all groups.

The broadcast upper-tree variant. Rows are reduced to leaves (in the JVM), range-sorted by group and order,
and numbered from the sizes of the sorted runs. Blocks of ``2 ** BLOCK`` neighbouring leaves are
reduced in tasks, which leaves one node a block; those are blocked and reduced again until at most ``TOP`` nodes remain.
The driver builds the tree over these, and what each of its nodes lacks up to the root (its suffix
path) is broadcast; executors put it behind the steps inside their blocks, which gives every row's proof, and fold
each row's leaf along it. Where there are more groups than ``TOP``, their subroots are numbered and
reduced like leaves of one more tree.

H is SHA-256 in lowercase hex of its inputs concatenated, digests as hex text. While a level has several nodes, every two
consecutive ones become their H; an odd last one becomes the H of itself.

Defined cases: a null or empty value of a column is ``-`` or ``0:``; a null group is a group of its own, before all
others; a null order value comes first, its row is never taken for tampered with. Rows of equal order stand
by their leaves, equal rows by their place in the input. An empty table has no root and gives no rows. A
counter that tampering takes past its type is written in full. Columns that are neither fields, group nor
order are not carried, whatever their names; the order column comes back under its name unless a result is named so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

#: Levels of a block: 4,096 leaves, half a MB as one row.
BLOCK = 12
#: Nodes that the driver builds the upper tree from, each with a path of about 1 KB; more are reduced by blocks first.
TOP = 8_192
#: Runs of sorted rows that are broadcast (40 bytes each); more are joined by shuffle.
RUNS = 50_000
#: The columns of a row's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and the ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        row = out[-1]
        out.append([digest(row[i] + (row[i + 1] if i + 1 < len(row) else "")) for i in range(0, len(row), 2)])
    return out


def height(nodes: int) -> int:
    return (nodes - 1).bit_length()


def steps(tree: list[list[str]], i: int) -> list[str]:
    """What the node at ``i`` lacks at each level: ``<`` or ``>`` for the side and the sibling's digest, or ``-``."""
    out = []
    for row in tree[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(row) else ("<" if j < i else ">") + row[j])
        i >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node gives with the siblings on its path."""
    for step in path:
        side, other = step[0], step[1:]
        node = digest(other + node if side == "<" else node + other)
    return node


def _split(path: str) -> list[str]:
    return path.split(",") if path else []


def _ranked(stash: Stash, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos, their place in ``grp`` by ``order``, and total, the group's rows. The order has to be total."""
    rows = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id())
    rows = stash.put(rows, f"{name}sorted").withColumn("_run", F.shiftright("_at", 33))
    group = Window.partitionBy("grp")
    runs = rows.groupBy("grp", "_run").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    runs = stash.put(runs.select("grp", "_run", "first", (F.sum("n").over(group.orderBy("_run")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total")), f"{name}runs")
    runs = F.broadcast(runs) if runs.count() <= RUNS else runs
    return rows.join(runs, ["grp", "_run"]).withColumn("pos", F.col("before") + F.col("_at") - F.col("first")).drop("_at", "_run", "first", "before")


def _blocks(rows: DataFrame, block: int, *cols: str) -> DataFrame:
    """A row for each block of ``2 ** block`` neighbours of a group: grp, pos of the block, total of the group, nodes by place."""
    keyed = rows.select("grp", F.shiftright("pos", block).alias("pos"), "total", F.struct("pos", *cols).alias("node"))
    return keyed.groupBy("grp", "pos").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("node")).alias("nodes"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    nodes = batch.column("nodes")
    for k in range(batch.num_rows):
        yield k, nodes[k].values


NODES, PATHS = "grp string, pos long, total long, digest string", "grp string, pos long, subroot string, path string"


def _reduced(blocks: DataFrame, block: int) -> DataFrame:
    """Blocks to their nodes one tier up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column("total").to_pylist()
            up = [levels(nodes.field("digest").to_pylist(), min(block, height(totals[k])))[-1][0] for k, nodes in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("pos"), pa.array([((t - 1) >> block) + 1 for t in totals], pa.int64()), pa.array(up, pa.string())], names=["grp", "pos", "total", "digest"])

    return blocks.mapInArrow(run, NODES)


def _descended(blocks: DataFrame, block: int) -> DataFrame:
    """Blocks with their own path to the paths of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, groups, subroots, paths = (batch.column(c).to_pylist() for c in ("total", "grp", "subroot", "path"))
            for k, nodes in _each(batch):
                tree, n = levels(nodes.field("digest").to_pylist(), min(block, height(totals[k]))), len(nodes)
                own = [",".join([*steps(tree, i), *_split(paths[k])]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([groups[k]] * n, pa.string()), nodes.field("pos"), pa.array([subroots[k]] * n, pa.string()), pa.array(own, pa.string())], names=["grp", "pos", "subroot", "path"])

    return blocks.mapInArrow(run, PATHS)


def top_tree(nodes: list[tuple[str, int, str]]) -> tuple[list[tuple[str, int, str, str]], str | None]:
    """(grp, pos, subroot, path) of all remaining nodes of all groups, and the root."""
    groups: dict[str, list[str]] = {}
    for grp, _, node in sorted(nodes, key=lambda n: (n[0].encode(), n[1])):
        groups.setdefault(grp, []).append(node)
    trees = {grp: levels(row, height(len(row))) for grp, row in groups.items()}
    upper = levels([tree[-1][0] for tree in trees.values()], height(len(trees)))
    out = []
    for g, (grp, tree) in enumerate(trees.items()):
        above = steps(upper, g)
        out += [(grp, i, tree[-1][0], ",".join([*steps(tree, i), *above])) for i in range(len(tree[0]))]
    return out, upper[-1][0] if groups else None


def _sized(paths: DataFrame, rows: int, top: int) -> DataFrame:
    return F.broadcast(paths) if rows <= top else paths


def _climb(stash: Stash, nodes: DataFrame, tier: int, block: int, top: int) -> tuple[DataFrame, int, str | None]:
    """The paths from ``nodes`` (grp, pos, total, digest; stored) to the root, how many they are, and the root (null of no nodes)."""
    count, widest = nodes.agg(F.count("*"), F.max("total")).first()
    if count <= top:
        paths, root = top_tree([tuple(n) for n in nodes.select("grp", "pos", "digest").collect()])
        return stash.spark.createDataFrame(paths, PATHS), count, root
    if widest == 1:  # more groups than the driver takes: their subroots are leaves of one tree
        rows = nodes.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
        ranked = stash.put(_ranked(stash, rows, ["name"], f"groups{tier}"), f"subroots{tier}")
        above, many, root = _climb(stash, ranked.select("grp", "pos", "total", "digest"), tier + 1, block, top)
        paths = ranked.join(_sized(above.select("pos", "path"), many, top), "pos").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path")
        return stash.put(paths, f"paths{tier}"), count, root
    blocks = stash.put(_blocks(nodes, block, "digest"), f"blocks{tier}")
    above, many, root = _climb(stash, stash.put(_reduced(blocks, block), f"nodes{tier}"), tier + 1, block, top)
    return stash.put(_descended(blocks.join(_sized(above, many, top), ["grp", "pos"]), block), f"paths{tier}"), count, root


RESULTS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", claims: dict[str, Column] | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """Each row's leaf, subroot, root, proof_sha256, folded_root, verified and proof under the manifest of ``docs``.

    ``claims`` gives what rows now say of some fields, where that may differ from what the manifest was built over:
    their leaves are taken from the claims and folded along the manifest's siblings. ``proof`` lists a row's steps: the side of the
    sibling (``<`` or ``>``) and its digest, or ``-`` where a level has none."""
    claims = claims or {}
    stash = Stash(docs.sparkSession, "merkle")
    named = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(order).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), leaf([claims.get(f, F.col(f)) for f in fields]).alias("claim"))
    rows = named.withColumns({"claim": F.when(F.col("claim") != F.col("digest"), F.col("claim")), "at": F.monotonically_increasing_id()})
    rows = _ranked(stash, stash.put(rows, "leaves"), ["key", "digest", "at"], "leaves")
    blocks = stash.put(_blocks(rows, block, "key", "digest", "claim"), "blocks")
    stash.drop("leaves", "leavessorted", "leavesruns")
    above, many, root = _climb(stash, stash.put(_reduced(blocks, block), "nodes"), 0, block, top)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, subroots, paths = (batch.column(c).to_pylist() for c in ("total", "subroot", "path"))
            for k, nodes in _each(batch):
                own, claimed = nodes.field("digest").to_pylist(), nodes.field("claim").to_pylist()
                tree, suffix = levels(own, min(block, height(totals[k]))), _split(paths[k])
                proofs = [steps(tree, i) + suffix for i in range(len(own))]
                folded = [fold(claimed[i] or own[i], proofs[i]) for i in range(len(own))]
                sums = [digest("".join(s[1:] for s in p)) for p in proofs]
                cols = [nodes.field("key"), nodes.field("digest"), *(pa.array([v] * len(own), pa.string()) for v in (subroots[k], root)), pa.array(sums, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()), pa.array(proofs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", *(c.split()[0] for c in RESULTS.split(", "))])

    key = docs.schema[order].dataType.simpleString()
    out = blocks.join(_sized(above, many, top), ["grp", "pos"]).mapInArrow(finish, f"key {key}, {RESULTS}")
    return out.withColumnRenamed("key", order)


def counted_up(order: str = "doc_id", counter: str = "n_chars") -> dict[str, Column]:
    """The tampering of the tests: one more in ``counter`` where 7 divides the CRC-32 of the order value as text; nulls stay."""
    chosen = F.crc32(F.col(order).cast("string").cast("binary")) % 7 == 0
    return {counter: F.when(chosen, (F.col(counter).cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col(counter).cast("string"))}
