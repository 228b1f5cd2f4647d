"""The corpus pipeline on a small corpus."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_edges import CLASHING


def test_stages(spark, tmp_path):
    base = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", f"s{i % 3}", 0) for i in range(80)]
    toxic = [(100 + i, " ".join(f"v{i}y{k}" for k in range(30)) + " grumble", "en", "s0", 0) for i in range(40)]
    copies = [(200 + i, base[i][1] + " tail", "en", "s1", 0) for i in range(5)]
    leak = [(300, "a b c " + base[0][1].replace("w0", "bench") + " d", "en", "s2", 0)]
    docs = spark.createDataFrame([*base, *toxic, *copies, *leak], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] in range(100, 200)), 1) for r in [*base, *toxic]], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, base[0][1].replace("w0", "bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "shard", "slot").collect()
    assert {r.doc_id for r in got} == set(range(80))
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name


def test_extra_columns_come_back_and_edges_are_kept(spark, tmp_path):
    """Clashing names, nulls, repeated rows and a long text through all stages."""
    names = CLASHING + ["_row", "_source", "_tokens", "_place", "exponent", "cut", "wins", "c", "id", "__row_a", "_found"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), f"s{i % 2}") for i in range(20)]
    rows += [(50, None, None), (51, "", "s1"), (52, " ".join(f"long{k}" for k in range(60_000)), "s1"), (53, "é" * 40, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    results = {"shard", "slot", "size", "text_crc32"}
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names if c not in results)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(len(got) // 24 + (s < len(got) % 24))]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
