"""The recursive splitter against a plain recursion."""

import random
import re

from pyspark.sql import functions as F

from tarnwick.functions.chunks import BLANK, FINE, LIMIT, MARKS, chunk_recursive

BRUTE_MARKS = [*MARKS, *FINE]


def parted(text, mark):
    """Pieces that begin with their mark."""
    cuts = [0, *(m.start() for m in re.finditer(mark, text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def recursed(text, marks, limit):
    if len(text) <= limit:
        return [text]
    if not marks:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    out, open_ = [], ""
    for piece in parted(text, marks[0]):
        if len(piece) > limit:
            out += ([open_] if open_ else []) + recursed(piece, marks[1:], limit)
            open_ = ""
        elif len(open_) + len(piece) > limit:
            out.append(open_)
            open_ = piece
        else:
            open_ += piece
    return out + ([open_] if open_ else [])


def brute(text, limit=LIMIT):
    blocks = [b.strip(BLANK) for b in (text or "").split("\n\n")]
    return [c.strip(BLANK) for b in blocks if b for c in recursed(b, BRUTE_MARKS, limit) if c.strip(BLANK)]


def texts():
    rng = random.Random(11)
    parts = ["\n", "\n", " ", " ", " ", "\n\n", "\n## ", "\n# ", "```\n", "\n---\n", "\n***\n", "\n____\n", "x", "word", "ü" * 7, "a" * 45, ".", "𝒳"]
    out = [None, "", " \n\n ", "short", "y" * 95, "y" * 30, "z" * 29 + " " + "z" * 31, " " * 70, "a\n\n\nb", "\n" * 40 + "q"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(400)]


def test_equals_a_plain_recursion(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, text string")
    for limit in (30, LIMIT):
        got = {r.id: r.c for r in df.select("id", chunk_recursive("text", limit).alias("c")).collect()}
        for i, text in rows:
            assert got[i] == brute(text, limit), (limit, text)
            assert all(len(c) <= limit for c in got[i])


def test_marks_come_before_lines_and_words(spark):
    head = "intro " * 30 + "\n## One\n" + "alpha " * 100 + "\n## Two\n" + "beta " * 110
    fence = "```\n" + "code\n" * 150 + "```\n" + "tail " * 120
    got = [r.c for r in spark.createDataFrame([(head,), (fence,)], "t string").select(chunk_recursive("t").alias("c")).collect()]
    assert got[0][0] == ("intro " * 30 + "\n## One\n" + "alpha " * 100).strip() and got[0][1].startswith("## Two\nbeta")
    assert got[1] == brute(fence) and len(got[1]) == 2


def test_nothing_is_lost(spark):
    text = " ".join(f"w{i}" for i in range(5000)) + "\n" + "v" * 2500
    (row,) = spark.createDataFrame([(text,)], "t string").select(chunk_recursive("t").alias("c")).collect()
    assert "".join(row.c).replace(" ", "") == re.sub(r"\s", "", text).replace(" ", "")
    assert spark.createDataFrame([(None,)], "t string").select(F.size(chunk_recursive("t"))).first()[0] == 0
