"""What the secret scan leaves behind, and values of any length."""

import hashlib
import subprocess

from tarnwick.llm import common, secrets


def test_no_run_stays_in_clear_and_long_values_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    long = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(120)) + "."
    short = "AKIA" + "QWERTYUIOPASDF12"
    docs = spark.createDataFrame([(1, f"see password={long} end"), (2, f"id {short} here"), (3, None), (4, "plain words " * 50)], "doc_id long, text string")
    found = secrets.scan_all(docs)
    rows = {r.run_sha256: r for r in found.collect()}
    whole = rows[hashlib.sha256(long[:-1].encode()).hexdigest()]
    assert whole.length == len(long) - 1 and whole.is_secret and hashlib.sha256(short.encode()).hexdigest() in rows
    left = [p for p in tmp_path.rglob("*.parquet")]
    assert left, "the result is read from the shared folder"
    for p in left:
        import pyarrow.parquet as pq

        stored = repr(pq.read_table(p).to_pylist())
        assert short not in stored and long[:64] not in stored and "password" not in stored
    assert subprocess.run(["find", str(tmp_path), "-name", "candidates*"], capture_output=True, text=True, check=True).stdout == ""
