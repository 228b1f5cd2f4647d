"""First-wins over urls and titles against a sequential pass, and on a hot title."""

import random

from pyspark.sql import functions as F

from tarnwick.operators import dedup


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return 200 * row[-1] / (len(a) + len(b))


def sequential(rows):
    urls, titles, kept = set(), {}, []
    for i, u, g, t in sorted(rows):
        if u in urls or (t and any(lcs_ratio(t, x) >= 97 for x in titles.get(g, []))):
            continue
        urls.add(u)
        if t:
            titles.setdefault(g, []).append(t)
        kept.append(i)
    return kept


def test_equals_a_sequential_pass(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef ") for _ in range(60)).strip() for _ in range(8)]
    rows = []
    for i in range(400):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, f"u{rng.randrange(150)}", f"g{rng.randrange(3)}", rng.choice(["".join(t), "".join(t), rng.choice(base), ""])))
    got = dedup.first_wins_titles(spark.createDataFrame(rows, "id int, u string, g string, t string")).collect()
    assert sorted(r.id for r in got) == sequential(rows)


def test_chains_over_both_kinds_of_class(spark):
    """Links that alternate between urls and titles are undone one after the other."""
    rows = [(i, f"u{(i + 1) // 2}", "g", f"title number {i // 2} " + "abcdefgh"[i // 2 % 8] * 9) for i in range(30)] + [(100, "u0", "g", "new"), (101, "n1", "g", None), (102, "n2", None, "new")]
    got = dedup.first_wins_titles(spark.createDataFrame(rows, "id int, u string, g string, t string")).collect()
    assert sorted(r.id for r in got) == sequential([r for r in rows if r[2]]) + [102]


def test_a_hot_title_makes_no_pairs(spark):
    rows = spark.range(100_000).select(F.col("id"), F.concat(F.lit("u"), "id").alias("u"), F.lit("host").alias("g"), F.lit("home").alias("t"))
    hot = rows.unionByName(spark.createDataFrame([(200_000, "u7", "other", "about"), (200_001, "v", "host", "contact")], "id long, u string, g string, t string"))
    got = sorted(r.id for r in dedup.first_wins_titles(hot).collect())
    assert got == [0, 200_000, 200_001]  # page 7 was dropped by its title, so its url is free


def test_empty(spark):
    assert dedup.first_wins_titles(spark.createDataFrame([], "id int, u string, g string, t string")).collect() == []
