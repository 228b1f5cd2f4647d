"""A corpus pipeline of five stages, each one operator over all rows that the stage before kept.

Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, the extra ones as they were,
whatever their names: a stage works on id, text and source, and the others wait under other names.

Defined cases of all stages: null and empty texts are kept by the first three (they are neither toxic nor
copies nor contaminated) and mixed and sharded like others; a null source is a source; a null id is an id
that names no component. Of equal rows all are kept or all go but in the near-duplicate stage, where rows equal in
id and text share the fate of their id; ties go to the smallest id. Very long texts are worked whole. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import decontam, minhash, mixing, ring_shard, toxicity
from tarnwick.llm.common import Stash


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame], *used: str) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on the columns that it reads, with all others carried along under names that clash with none."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in used else f"_extra{k}" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        results = [c for c in out.columns if c not in names]
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in results), *results)

    return run


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash.near_duplicates(docs).where("kept").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their temperature weights; every document is read at least once."""
    return mixing.mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the shard and slot they are written to; extra columns named like these results are replaced."""
    return ring_shard.assign(ring_shard.measured(docs)).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


STAGES = [
    ("toxicity", apart(toxic, "doc_id", "text")),
    ("near duplicates", apart(near_duplicates, "doc_id", "text")),
    ("decontamination", apart(decontaminate, "doc_id", "text")),
    ("mixing", apart(mix_sources, "doc_id", "text", "source")),
    ("sharding", apart(shards, "doc_id", "text")),
]

#: Learnt scores and hashed rings are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash.put(stage(spark, docs, sf_dir), str(k))
        stash.keep(str(k))
    return docs
