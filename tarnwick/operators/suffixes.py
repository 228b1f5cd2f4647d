"""Registrable domains by a table of public-suffix rules, wildcards and exceptions included.

Rules come as the lines of the public list (``com``, ``co.uk``, ``*.ck``, ``!www.ck``, ``// comments``), from a path or a table, so
their number is data. Each distinct host is exploded to its endings, which meet the rules in an equality join on the ending; of
the rules that fit an exception wins, else the longest, and the domain is one label more.

Defined cases: a host is taken in lower case, without white space, trailing dots and a leading ``www.``; numeric and bracketed
addresses, hosts that no rule fits, and hosts that are a suffix themselves are their own domain; null and empty hosts
stay as they are. Repeated rules count once, blank lines and comments not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.urls import canonical_host


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ending, kind) from a file of the list's form."""
    return parsed(spark.read.text(path).select(F.col("value").alias("line")))


def parsed(lines: DataFrame) -> DataFrame:
    """(ending, kind) of lines; kind is exact, wildcard or exception, the ending without its mark."""
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1))
    rules = lines.select(rule.alias("r")).where(~F.startswith("r", F.lit("//")) & (F.col("r") != ""))
    kind = F.when(F.startswith("r", F.lit("!")), "exception").when(F.startswith("r", F.lit("*.")), "wildcard").otherwise("exact")
    return rules.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("ending"), kind.alias("kind")).distinct()


def registrable(df: DataFrame, host: str, rules: DataFrame, name: str = "registrable") -> DataFrame:
    """``df`` with the registrable domain of its host column."""
    hosts = df.select(F.col(host).alias("_host")).distinct().withColumn("_h", canonical_host(F.col("_host")))
    labels = F.split("_h", r"\.")
    named = hosts.where(F.col("_h").isNotNull() & (F.col("_h") != "") & ~F.col("_h").rlike(r"^[0-9.]+$|^\[")).withColumn("_n", F.size(labels))
    each = named.select("_host", "_h", "_n", F.explode(F.sequence(F.lit(1), "_n")).alias("_k"))
    each = each.withColumn("ending", F.expr("substring_index(_h, '.', -_k)"))
    met = each.join(rules, "ending")
    # how many labels the suffix has: a wildcard takes one more, if there is one, an exception one less
    long = F.when(F.col("kind") == "exact", F.col("_k")).when(F.col("kind") == "wildcard", F.when(F.col("_n") > F.col("_k"), F.col("_k") + 1)).otherwise(F.col("_k") - 1)
    best = met.withColumn("_long", long).where("_long is not null").groupBy("_host").agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), F.col("_long").alias("n"))).alias("s"))
    out = hosts.join(best, "_host", "left")
    domain = F.when(F.col("s.n") >= F.size(labels), F.col("_h")).otherwise(F.expr("substring_index(_h, '.', -(s.n + 1))"))
    out = out.select("_host", F.coalesce(domain, "_h").alias("_domain"))
    joined = df.join(out, F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.withColumn(name, F.col("_domain")).drop("_host", "_domain")
