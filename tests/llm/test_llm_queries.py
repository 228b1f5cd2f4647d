"""The registered queries of the training-data operators, against DuckDB or brute force on small tables."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest

from tarnwick.llm import queries, ring_shard, secrets, telephony
from tests.llm.test_operators import brute_repeats

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    want = sorted(repr([plain(v) for v in r]) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]}) AS q").fetchall())
    assert got == want and got


def test_op5_law(spark, docs):
    rows = queries.op5_ring_shards(spark, SMALL).collect()
    raw = {i: (t or "").encode() for i, t in docs}
    assert sorted(r.doc_id for r in rows) == sorted(raw)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id]), "rows", None) for r in rows)
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op5_overflow_goes_clockwise(spark):
    """Against a ring worked key by key: a key goes to the first point clockwise whose shard has room."""
    n, shards, vnodes = 300, 5, 6
    points = ring_shard.ring(shards, vnodes)
    got = ring_shard.assign(spark.range(n).withColumnRenamed("id", "doc_id"), shards=shards, vnodes=vnodes, slack=0.1).collect()
    loads = [sum(r.shard == s for r in got) for s in range(shards)]
    rooms = ring_shard.capacities(n, shards, 0.1)
    assert all(a <= b for a, b in zip(loads, rooms, strict=True)) and sum(loads) == n
    # unbounded homes: a shard that isn't full keeps every key of its own arcs
    home = {r.doc_id: r.shard for r in ring_shard.owners(spark.range(n).withColumnRenamed("id", "doc_id"), shards=shards, vnodes=vnodes).collect()}
    for r in got:
        if loads[home[r.doc_id]] < rooms[home[r.doc_id]]:
            assert r.shard == home[r.doc_id]
    assert len(points) == shards * vnodes


@pytest.mark.parametrize(("slack", "share"), [(0.0, 0.13), (0.25, 0.1)])
def test_one_more_shard_moves_few_rows(spark, slack, share):
    """24 to 25 shards: 4 % of the keys have to move; dealing anew would move 96 %."""
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    old, new = ({r.doc_id: r.shard for r in ring_shard.assign(keys, shards=n, slack=slack).collect()} for n in (24, 25))
    assert sum(old[k] != new[k] for k in old) / len(old) < share


def test_op6_equals_brute_force(spark, docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SMALL).collect())
    assert got == brute_repeats(docs)


def test_op8_media(spark, docs):
    """Stored form, payload and PCM of every text, made anew from the text alone."""
    got = {r.doc_id: r for r in queries.op8_telephony(spark, SMALL).collect()}
    assert len(got) == len(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in docs:
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192)
        media, r = telephony.carry(payload), got[i]
        sound = telephony.resample(telephony.decode([media])[0], 8000, 16000)
        pcm = telephony.wave(telephony.PCM, sound.astype("<i2").tobytes(), rate=16000, align=2, bits=16)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.pcm_bytes, r.pcm_sha256) == (len(media), sha(media), len(pcm), sha(pcm))
        assert r.feature.endswith(telephony.features(sound))


def test_op9_equals_brute_force(spark, docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {(i, len(sets[i]), find(i), find(i) == i) for i in ids}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op9_minhash(spark, SMALL).collect()} == want


def held_out_findings(n=240, seed=11):
    """(text, runs that are secrets, runs that are not) in shapes that the training table doesn't have."""
    rnd = random.Random(seed)
    pick = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hexa = "0123456789abcdef"
    words = "river stone letter winter garden motion signal paper window market number system return create object method string global static public".split()
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        kind = i % 12
        good, bad = [], []
        if kind == 0:
            good = ["xoxb-" + pick("0123456789", 11) + "-" + pick(mixed, 24)]
            line = f"slack_token: {good[0]}"
        elif kind == 1:
            good = ["AIza" + pick(mixed, 35) + "7"]
            line = f'const key = "{good[0]}";'
        elif kind == 2:
            good = ["glpat-" + pick(mixed, 19) + "4"]
            line = f"curl --header PRIVATE-TOKEN: {good[0]}"
        elif kind == 3:
            good = [pick(mixed, 43) + "9"]
            line = f"AWS_SECRET_ACCESS_KEY={good[0]}"
        elif kind == 4:
            good = ["sk_live_" + pick(mixed, 23) + "1"]
            line = f"stripe.api_key = '{good[0]}'"
        elif kind == 5:
            good = [pick(mixed, 9) + "5"]
            line = f"db.password={good[0]}"
        elif kind == 6:
            bad = [pick(hexa, 39) + "7"]
            line = f"merge revision {bad[0]} into main"
        elif kind == 7:
            bad = [pick(hexa, 31) + "3"]
            line = f"md5 {bad[0]}  archive.tar"
        elif kind == 8:
            bad = ["_".join(rnd.choice(words) for _ in range(4)) + "_2"]
            line = f"call {bad[0]} twice"
        elif kind == 9:
            bad = ["/".join(rnd.choice(words) for _ in range(4)) + "/page7"]
            line = f"see {bad[0]} for more"
        elif kind == 10:
            bad = [rnd.choice(words) + "".join(w.title() for w in rnd.sample(words, 3)) + "2"]
            line = f"new {bad[0]} here"
        else:
            bad = [pick("123456789", 18)]
            line = f"order {bad[0]} shipped"
        out.append((f"{say(6)}. {line}\n{say(5)}", good, bad))
    return out


def test_op2_on_held_out_findings(spark):
    """Precision and recall on shapes that the forest hasn't been trained on (figures in the README)."""
    cases = held_out_findings()
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {(r.doc_id, r.run_sha256): r.is_secret for r in secrets.scan_all(docs).collect()}
    good = [found.get((i, sha(g)), False) for i, (_, gs, _) in enumerate(cases) for g in gs]
    bad = [found.get((i, sha(b)), False) for i, (_, _, bs) in enumerate(cases) for b in bs]
    hits, alarms = sum(good), sum(bad)
    kinds = sorted({i % 12 for i, (_, _, bs) in enumerate(cases) for b in bs if found.get((i, sha(b)))})
    print("recall", hits / len(good), "precision", hits / max(1, hits + alarms), "kinds with false alarms", kinds)
    # floors under what was measured when the set was made: 1.00 and 0.86
    assert hits / len(good) >= 0.9 and hits / (hits + alarms) >= 0.8


def test_op2_runs_over_the_whole_table(spark, docs):
    rows = queries.op2_secrets(spark, SMALL).collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in docs} and all(0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5) for r in rows)
