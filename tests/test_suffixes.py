"""Suffix rules against a plain search of the longest one."""

import random

from tarnwick.operators import suffixes

LIST = """// the list's form
com
co.uk   trailing words don't count
uk

*.ck
!www.ck
!city.kobe.jp
*.kobe.jp
jp
com
a.b.c.com
"""


def brute(host, rules):
    if host is None:
        return None
    h = host.strip().lower().rstrip(".")
    h = h[4:] if h.startswith("www.") else h
    w = h.split(".")
    if not h or h[0] == "[" or all(c in "0123456789." for c in h):
        return h
    fits = []
    for rule in rules:
        r = rule.lstrip("!").split(".")
        if len(r) <= len(w) and all(x in ("*", y) for x, y in zip(reversed(r), reversed(w))):
            fits.append((rule[0] == "!", len(r) - (rule[0] == "!")))
    if not fits or max(fits)[1] >= len(w):
        return h
    return ".".join(w[-max(fits)[1] - 1 :])


def test_equals_a_plain_search(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(LIST)
    rules = {x.split()[0] for x in LIST.splitlines() if x.strip() and not x.startswith("//")}
    rng = random.Random(2)
    parts = ["com", "co", "uk", "ck", "www", "kobe", "jp", "city", "a", "b", "c", "zz", "X"]
    hosts = [None, "", "com", "ck", "www.ck", "x.ck", "a.x.ck", "kobe.jp", "c.kobe.jp", "q.c.kobe.jp", "city.kobe.jp", "x.city.kobe.jp", "10.0.0.1", "[::1]", "localhost", "Example.COM.", " www.example.co.uk "]
    hosts += [".".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts + hosts[:40])], "i int, host string")
    got = suffixes.registrable(df, "host", suffixes.read_rules(spark, f"file://{tmp_path}/rules.dat")).collect()
    assert len(got) == len(hosts) + 40
    for r in got:
        assert r.registrable == brute(r.host, rules), r.host
