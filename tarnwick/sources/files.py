"""Readers and writers: JSON arrays, JSON lines, crawl streams, raw texts and file sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_SPEC = "id string, query string, include_domains array<string>, exclude_domains array<string>, time_range string, notes string, judgments struct<expected_domains: array<string>, freshness_sensitive: boolean, top3_usefulness_target: int, top5_usefulness_target: int>"


def query_specs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from a JSON array."""
    return spark.read.schema(QUERY_SPEC).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """(url, content): whole files as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))


def crawl_stream(lines: DataFrame, schema: str = "status string, url string, error string, html string") -> DataFrame:
    """Rows of crawl streams (stream, line_no, value): up to the line that says completed, blanks and
    junk skipped; a failed line before that raises."""
    parsed = lines.where(F.col("value").rlike(r"^\s*\{")).withColumn("r", F.from_json("value", schema)).where("r is not null")
    w = Window.partitionBy("stream")
    end = F.min(F.when(F.col("r.status") == "completed", F.col("line_no"))).over(w)
    kept = parsed.withColumn("_end", end).where("_end is null or line_no < _end").drop("_end")
    said = F.concat(F.lit("crawl failed: "), F.coalesce("r.error", F.lit("unknown")))
    ok = F.when(F.col("r.status") == "failed", F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return kept.where(ok).select("stream", "line_no", "r.*")


def sniff(first_bytes: Column) -> Column:
    """A mime type from the first bytes, or null."""
    h = F.hex(F.substring(first_bytes, 1, 8))
    return F.when(F.startswith(h, F.lit("25504446")), "application/pdf").when(F.startswith(h, F.lit("504B0304")), "application/zip").when(F.startswith(h, F.lit("89504E47")), "image/png").when(F.startswith(h, F.lit("3C21")) | F.startswith(h, F.lit("3C68")), "text/html").when(F.startswith(h, F.lit("7B")) | F.startswith(h, F.lit("5B")), "application/json")


def retryable(status: Column, error: Column) -> Column:
    """Server errors and transport errors are tried again."""
    return F.coalesce(status >= 500, F.lit(False)) | F.coalesce(error.isin("timeout", "transport"), F.lit(False))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in a closed schema: columns cast and in its order, missing ones null, others dropped."""
    from pyspark.sql.types import _parse_datatype_string

    there = set(df.columns)
    fields = _parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def unwrap(df: DataFrame, value: str) -> DataFrame:
    """``df`` with result, a variant: of each answer's envelope the first of ``results``, else ``result``, else itself.

    Answers without JSON, with an empty list, or whose result is no object, have no row."""
    v = df.withColumn("_v", F.try_parse_json(value)).where("_v is not null")
    listed = F.schema_of_variant(F.try_variant_get("_v", "$.results", "variant")).startswith("ARRAY")
    one = F.when(F.coalesce(listed, F.lit(False)), F.try_variant_get("_v", "$.results[0]", "variant")).otherwise(F.coalesce(F.try_variant_get("_v", "$.result", "variant"), F.col("_v")))
    return v.withColumn("result", one).where(F.schema_of_variant("result").startswith("OBJECT")).drop("_v")
