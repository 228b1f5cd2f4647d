"""The titles' candidates against brute force, on patterns and odd strings, and how their number grows."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import dedup, windows
from tests.test_titles import lcs_ratio


def strings(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "c long, g string, t string").localCheckpoint()


def changed(rng, t, letters):
    t = list(t)
    for _ in range(rng.randrange(5)):
        k = rng.randrange(len(t))
        t[k : k + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
    return "".join(t)


@pytest.mark.parametrize("least", [97.0, 90.0])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least))
    base = [
        *("".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefgh ", "aé漢😀") for n in (9, 16, 17, 18, 33, 60, 140)),
        "abc " * 15,
        "z" * 50,
        "product 1234567 of a shop with a long name",
    ]
    rows = sorted({("g", changed(rng, rng.choice(base), "abz1é😀")) for _ in range(240)} | {("h", b) for b in base})
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a < b and abs(len(a) - len(b)) <= (1 - least / 100) * (len(a) + len(b)) + 1e-9 and lcs_ratio(a, b) >= least}
    got = dedup.fuzzy_titles(spark.createDataFrame(rows, "g string, t string"), least).collect()
    assert {(r.g, r.ta, r.tb) for r in got} == want and len(got) == len(want) > 40


def test_very_long_titles(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef ") for _ in range(windows.EVEN + 100))
    b = a[:50] + "xyz" + a[53:900] + a[910:]
    got = windows.candidates(strings(spark, [("g", x) for x in (a, b, a[:1500], b[::-1])]), 0.03).collect()
    assert [(r.x, r.y) for r in got] == [(1, 0)]


def test_candidates_grow_with_the_titles(spark):
    """Titles of one host that are made of the same few syllables meet few others; those of one pattern meet where some digits agree."""
    rng = random.Random(3)
    syllables = "the tion er ing and of on re ha ed is en st th an at ou ea or ti wh nt ble sh ly".split()
    texts = {"".join(rng.choice(syllables) + rng.choice(["", " "]) for _ in range(40))[:60] for _ in range(4000)}
    pattern = {f"{rng.randrange(10**9):09} of a shop with a long name" for _ in range(4000)}
    for some, most in ((texts, 5 * len(texts)), (pattern, len(pattern) ** 2 // 200)):
        met = windows.candidates(strings(spark, [("h", t) for t in sorted(some)]), 0.03)
        assert met.count() < most


def test_groups_and_nulls(spark):
    t = "a title of thirty letters or more"
    rows = spark.createDataFrame([("g", t), ("g", t + "s"), ("h", t + "x"), (None, t + "y"), (None, t + "z"), ("g", "")], "g string, t string")
    assert [(r.g, r.ta, r.tb) for r in dedup.fuzzy_titles(rows).collect()] == [("g", t, t + "s")]
    assert dedup.fuzzy_titles(rows, 100.0).count() == 0
    with pytest.raises(ValueError, match="least"):
        dedup.fuzzy_titles(rows.where(F.col("g").isNotNull()), 60.0)
