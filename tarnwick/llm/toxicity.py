"""Toxicity by weak supervision.

Voters are lexicon and pattern rules: a word, or any word with a prefix of 3 to 6 letters. They are
found on labelled rows by their association with the label (words and beginnings that toxic texts
have far more often, and some that they have less often). From then on the truth is latent. A
generative label model estimates by expectation-maximisation, over labelled and unlabelled rows, how
often each voter speaks on toxic and on clean texts (silence is an abstention), and from what the votes have in common beyond the class
which voters are correlated: those share their word. A given label is one more voter, whose accuracy is
estimated like the others'; it only anchors which class is which, and clear votes overrule it. A
linear classifier (logistic, with a ridge) is trained on the labelled rows' posteriors with the voters as
features, and scores every whole text.

The fit uses bounded samples: of the labelled rows the ``SAMPLE`` of smallest hash of their id, and as
unlabelled rows those of the ``UNLABELLED`` documents of smallest hash that are not among them. All else
covers all rows. The model is a dictionary of at most ``VOTERS`` voters (those of the strongest
association); scoring is row by row.

Defined cases: null and blank texts have no words and get the classifier's base score; labels with
null are ignored, of several labels of a row the largest counts; without labels of both kinds every
score is the share of toxic labels, or 0. Ids may be of any type and are compared as text; a null id
has no label. Repeated rows have equal scores, and count each in the sample; ties of association are
kept in the voters' alphabetical order. An empty table gives an empty result. Extra columns pass through; those named
score or predicted are replaced. Labels, language, source and id are no inputs of a score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, small_batches

#: Labelled and unlabelled rows in the fit at most, and voters of the model at most.
SAMPLE, UNLABELLED, VOTERS = 16_000, 8_000, 400
PREFIXES = (3, 4, 5, 6)
#: Rows that a voter must have spoken on, its least log-likelihood ratio and its least log odds.
SUPPORT, RATIO, LIFT = 8, 50.0, 1.0
#: Rows that the belief in given labels weighs, and that belief; correlations under COMMON are taken for chance.
BELIEF, RIGHT, COMMON = 10.0, 0.95, 0.05
#: What a labelled row counts for its given label in a voter's rates, beside 1 for its posterior.
ANCHOR = 1.0
WORDS = re.compile(r"\w+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a null id has none and isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rules(word: str) -> list[str]:
    """The voters that a word can set off."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


def rules_of(text: str) -> set[str]:
    found: set[str] = set()
    for w in set(WORDS.findall(text.lower())):
        found.update(rules(w))
    return found


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rule, toxic rows, clean rows) of a task's labelled texts."""

    def flush(seen: list[Counter]) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["rule", "t", "c"])

    seen = [Counter(), Counter()]
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(rules_of(text or ""))
        if len(seen[0]) + len(seen[1]) > 500_000:
            yield flush(seen)
            seen = [Counter(), Counter()]
    yield flush(seen)


def general(found: dict[str, tuple[float, float]]) -> list[tuple[str, float]]:
    """(rule, lift) without rules that a kept beginning of theirs covers as well, strongest first."""
    out: dict[str, float] = {}
    for rule in sorted(found, key=lambda r: (len(r.lstrip("=")) + r.startswith("="), r)):
        lift, word = found[rule][1], rule.lstrip("=")
        covers = [out[word[:k]] for k in PREFIXES if k <= len(word) and word[:k] in out and word[:k] != rule]
        if not any(x * lift > 0 and abs(x) >= 0.8 * abs(lift) for x in covers):
            out[rule] = lift
    return sorted(out.items(), key=lambda x: (-found[x[0]][0], x[0]))


class Voters:
    """Which voters speak on a text; words' voters are remembered."""

    def __init__(self, names: list[str]) -> None:
        self.ids = {n: i for i, n in enumerate(names)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        out: set[int] = set()
        memo = self.memo
        for w in set(WORDS.findall(text.lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) > 300_000:
                    memo.clear()
                got = memo[w] = tuple(self.ids[r] for r in rules(w) if r in self.ids)
            out.update(got)
        return sorted(out)


@dataclass
class LabelModel:
    """What the label model has estimated."""

    posterior: np.ndarray  # of each row
    accuracy: np.ndarray  # share of each voter's votes that are right
    correlation: np.ndarray  # of pairs of voters, beyond the class
    labels: tuple[float, float]  # share of toxic and of clean rows whose given label is right


def parts(rows: int, each: int = 2_000) -> list[slice]:
    """Rows by the thousand: the driver holds a few MB of what is worked out from them, not as much as all votes again."""
    return [slice(k, k + each) for k in range(0, rows, each)]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30) -> LabelModel:
    """The latent classes behind votes (rows x voters: 1 toxic, -1 clean, 0 none) and given labels (1, 0, or -1 for none).

    The first estimates are the labelled rows'; then all rows count by their posterior. A voter that
    doesn't speak says nothing, so kinds of toxicity with voters of their own don't outvote each other;
    what speaks is that no voter does. The balance of the classes and that share are the labelled rows',
    and labels are checked where voters speak: elsewhere nothing could tell them from the truth."""
    n, m = votes.shape
    yes, no, has = (votes > 0).astype(np.float32), (votes < 0).astype(np.float32), given >= 0
    prior = float(np.clip(given[has].mean() if has.any() else 0.5, 0.01, 0.99))
    q = np.where(given == 1, RIGHT, np.where(given == 0, 1 - RIGHT, prior))
    seen = has.astype(float) if has.any() else np.ones(n)  # rows that count
    mute = ~votes.any(1)
    shares = [((mute & (given == y)).sum() + 1) / ((given == y).sum() + 2) for y in (1, 0)]
    start = math.log(prior / (1 - prior)) + mute * math.log(shares[0] / shares[1])
    correlation, own = np.eye(m), np.ones(m)
    least = max(COMMON, 4 / math.sqrt(n))
    for k in range(rounds):
        t, c = seen * q, seen * (1 - q)
        rate = {(v, y): (x.T @ (w + ANCHOR * (given == y)) + 0.5) / (w.sum() + ANCHOR * (given == y).sum() + 1) for v, x in ((1, yes), (-1, no)) for y, w in ((1, t), (0, c))}
        right = [(w[~mute & (given == y)].sum() + BELIEF * RIGHT) / (w[~mute & has].sum() + BELIEF) for y, w in ((1, t), (0, c))]
        if k in (1, 5, 10, 20):
            common = np.zeros((m, m))
            for part in parts(n):
                p = q[part, None]
                rest = votes[part] - (p * (rate[1, 1] - rate[-1, 1]) + (1 - p) * (rate[1, 0] - rate[-1, 0]))
                common += rest.T @ rest
            size = np.sqrt(np.diag(common)) + 1e-9
            correlation = common / np.outer(size, size)
            shared = np.where(correlation >= least, correlation, 0) ** 2
            np.fill_diagonal(shared, 1)
            own = 1 / shared.sum(0)
        score = yes @ (np.log(rate[1, 1] / rate[1, 0]) * own) + no @ (np.log(rate[-1, 1] / rate[-1, 0]) * own) + start
        said = np.where(given == 1, math.log(right[0] / (1 - right[1])), np.where(given == 0, math.log((1 - right[0]) / right[1]), 0))
        new = 1 / (1 + np.exp(-np.clip(score + said, -30, 30)))
        moved, q, seen = np.abs(new - q).max(), new, np.ones(n)
        if k > 20 and moved < 1e-4:
            break
    np.fill_diagonal(correlation, 1)
    accuracy = (yes.T @ q + no.T @ (1 - q) + 0.5) / (yes.sum(0) + no.sum(0) + 1)
    return LabelModel(q, accuracy, correlation, (float(right[0]), float(right[1])))


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and base of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    r = np.full(len(w), ridge)
    r[-1] = 1e-3
    for _ in range(steps):
        g, h = r * w, np.diag(r)
        for part in parts(len(x)):
            a = np.hstack([x[part], np.ones((len(x[part]), 1))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g += a.T @ (p - q[part])
            h += (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = VOTERS) -> dict:
    """The model {voters, weights, base} from rows that are not held out."""
    stash = Stash(docs.sparkSession, "toxicity")
    key, learnt = F.col(id_col).cast("string"), F.col(id_col).isNotNull() & ~held_out(id_col)
    known = labels.where(F.col(label).isNotNull() & learnt).groupBy(key.alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic")).where("toxic in (0, 1)")
    known = stash.put(known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE), "known")
    n, t = known.agg(F.count("*"), F.sum("toxic")).first()
    t = t or 0
    if not n or t in (0, n):
        stash.drop("known")
        return {"voters": [], "weights": [], "base": 40.0 if n and t == n else -40.0}
    more = docs.where(learnt).select(key.alias("_id")).orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(UNLABELLED)
    # at most SAMPLE + UNLABELLED rows of two numbers
    asked = stash.put(known.unionByName(more.distinct().join(known, "_id", "left_anti").withColumn("toxic", F.lit(-1))), "asked")
    rows = stash.put(docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(asked), "_id"), "rows")
    tally = rows.where("toxic >= 0").select("text", "toxic").mapInArrow(_tally, "rule string, t long, c long").groupBy("rule").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    tally = tally.where(F.col("t") + F.col("c") >= SUPPORT)
    seen = F.col("t") + F.col("c")
    part = lambda k, total: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * n / (seen * total))).otherwise(0.0)
    tally = tally.withColumn("ratio", F.round(2 * (part("t", t) + part("c", n - t)), 6))
    tally = tally.withColumn("lift", F.round(F.log((F.col("t") + 0.5) * (n - t + 1) / ((F.col("c") + 0.5) * (t + 1))), 6))
    # rules of a bounded sample that are far from chance
    strong = tally.where((F.col("ratio") >= RATIO) & (F.abs("lift") >= LIFT)).collect()
    kept = general({r["rule"]: (r["ratio"], r["lift"]) for r in strong})[:most]
    names, side = [r for r, _ in kept], np.array([1 if lift > 0 else -1 for _, lift in kept], np.float32)
    if not names:
        stash.drop("known", "asked", "rows")
        return {"voters": [], "weights": [], "base": math.log((t / n) / (1 - t / n))}

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([voters(x or "") for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["_id", "toxic", "votes"])

    # SAMPLE + UNLABELLED rows of at most VOTERS small numbers
    got = rows.select("_id", "toxic", "text").mapInArrow(speak, "_id string, toxic int, votes array<int>").orderBy("_id", "toxic", "votes").toArrow()
    votes = np.zeros((got.num_rows, len(names)), np.float32)
    heard = got.column("votes").combine_chunks()
    votes[np.repeat(np.arange(got.num_rows), np.diff(heard.offsets.to_numpy())), heard.flatten().to_numpy()] = 1
    given = got.column("toxic").to_numpy()
    votes *= side
    model = label_model(votes, given)
    np.abs(votes, out=votes)
    # rows without a label teach what voters are worth; where few voters speak their posteriors are too vague to train on
    weights, base = logistic(votes[given >= 0], model.posterior[given >= 0])
    stash.drop("known", "asked", "rows")
    return {"voters": names, "weights": [float(w) for w in weights], "base": base}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; other columns pass through."""
    small_batches(docs.sparkSession)
    names, weights, base = model["voters"], np.array(model["weights"]), model["base"]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = Voters(names)
        for each in texts:
            sums = np.array([float(weights[voters(x)].sum()) if names and x else 0.0 for x in each]) + base
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -700, 700))))

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
