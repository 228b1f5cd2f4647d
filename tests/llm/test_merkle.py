"""The Merkle manifest against a plain tree, for every shape of blocks and top."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def brute(rows):
    """{row: (leaf, subroot, root, proof digest, folded root, verified)} by the rules, recursively and in one place."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, h(*map(enc, r))))
    trees = {}
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = climb([leaf for _, leaf in groups[g]])
    top = climb([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, tree) in enumerate(trees.items()):
        for i, (r, leaf) in enumerate(groups[g]):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = h(*map(enc, (*r[:3], r[3] + 1, r[4]))) if changed else leaf, ""
            for part, at in ((tree, i), (top, k)):
                for row in part[:-1]:
                    pair = row[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(pair[: at % 2] + pair[at % 2 + 1 :])
                    pair[at % 2] = node
                    node, at = h(*pair), at // 2
            out.append((r[0], leaf, tree[-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "s", "é"]), rng.choice(langs), rng.choice([None, 0, 9, 99]), rng.choice([None, "", f"text {i} ü"])) for i in rng.sample(range(10 * n), n)]


def proven(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.prove(df.repartition(3), claims=merkle.counted_up(), **how)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.select(cols).collect()), key=repr)


@pytest.mark.parametrize(("n", "langs", "how"), [(300, ["en", "de", None, "ß", ""], {}), (1, ["en"], {}), (2, [None], {}), (171, ["en", "de", "fr"], {"block": 2, "top": 9}), (130, ["x"], {"block": 3, "top": 1}), (60, [f"l{i}" for i in range(40)], {"block": 1, "top": 4})])
def test_equals_a_plain_tree(spark, n, langs, how):
    rows = rows_of(n, langs)
    assert proven(spark, rows, **how) == brute(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "s", "en", 2**63 - 1, "x")] * 5 + [(7, "s", "en", 1, "y"), (8, "s", "en", 1, "")]
    assert proven(spark, rows) == brute(rows)
    assert proven(spark, rows, block=1, top=2) == brute(rows)


def test_large_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUNS", 0)
    rows = rows_of(90, ["en", "de"])
    assert proven(spark, rows, block=2, top=2) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(rows_of(20, ["en"]), SCHEMA)
    plain = merkle.prove(df).orderBy("doc_id").collect()
    names = ["leaf", "root", "grp", "pos", "total", "key", "digest", "claim", "at", "_at", "_run", "first", "before", "n", "path", "nodes"]
    assert merkle.prove(df.withColumns({c: F.lit("x") for c in names})).orderBy("doc_id").collect() == plain


def test_a_changed_row_fails_and_its_proof_is_whole(spark):
    rows = rows_of(40, ["en", "de"])
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.prove(df, claims={"text": F.when(F.col("doc_id") == rows[3][0], "forged").otherwise(F.col("text"))}).collect()
    assert [r.doc_id for r in got if not r.verified] == [rows[3][0]]
    for r in got:
        if r.verified:
            assert merkle.fold(r.leaf, r.proof) == r.root and h("".join(s[1:] for s in r.proof)) == r.proof_sha256
