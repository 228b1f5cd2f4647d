"""Secret scans: candidates from patterns, false positives removed by a random forest.

Candidates are all key-like runs of a text (16 or more of ``A-Z a-z 0-9 + / _ -`` with a digit), as
many as a word has, each with its offset; values below that bar which a name announces (``password=``,
``"secret": ``, ``apiKey:``); and the headers of PEM private keys. A random forest (``pyspark.ml``, in
the JVM) judges them by length, character
transitions, composition and entropy, by how much of the run dictionary words cover, by the path the
text comes from, and by the words before it. It is trained from labelled findings; ``findings``
makes a labelled table of public credential shapes and of the usual false positives (digests,
identifiers, placeholders, joined words, dates, numbers) for where no reviewed findings exist.

The dictionary is counted over all texts: words of 4 to 12 letters in at least a ``COMMON`` share of the rows (3 at
least). A run is parted where a capital follows a small letter; its letters that lie in any dictionary word are covered.

Scale. All row by row in Catalyst expressions but two sums: the dictionary's counts (map-side) and
the coverage of candidates, joined by word piece with AQE's skew handling. Candidates are few and
carry no text. The training table is bounded by ``TRAIN`` rows. What stays in the shared folder for the result to read holds hashes and
numbers only; tables with the runs in clear are removed before the operator returns.

Defined cases: null and empty texts have no candidates; repeated rows give repeated findings; a
null path has no path features; a score of exactly one half is a finding; an empty table gives an empty result. Results have
the columns named at ``scan`` only, whatever extra columns the texts have; ids may be of any type. The candidate itself is not returned, only its SHA-256, the place of
its word and its offset there. Of the text around a candidate the nearest ``NEAR`` characters of a word
are looked at, values and runs are taken whole; a later run of a word is judged by the names
between it and the run before, or, if there are none (lists), by the words before.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, lower_ascii, row_hash

RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}"
#: Rows in the training table at most; trees and depth of the forest.
TRAIN, TREES, DEPTH = 20_000, 24, 7
COMMON = 1e-4
AROUND = 3
# Words that announce a secret, words that announce something else, path parts of no concern.
ANNOUNCE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential", "credentials", "auth", "bearer", "aws", "private")
DENY = ("sha1", "sha256", "md5", "checksum", "commit", "digest", "uuid", "guid", "hash", "revision", "integrity", "etag", "example", "sample", "dummy")
CALM_PATHS = ("test", "example", "sample", "doc", "fixture", "mock")
#: A name that announces a value, up to the value; the value; the header of a private key.
ANNOUNCED = r"(?:(?<![A-Za-z])(?i:" + "|".join(ANNOUNCE) + r")|(?:Password|Passwd|Pwd|Secret|Token|Key|Credential|Auth))s?[\\\"'`]{0,4}\s*+(?:=>|:=|==?|:)\s*+[\\\"'`]{0,4}(?=[^\s\"'`,;&<>\\])"
VALUE = r"[^\s\"'`,;&<>\\]*[^\s\"'`,;&<>\\.)\]}]"
PEM = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
#: Stands before announced values and headers while words are parted; characters looked at beside a candidate.
MARK, NEAR = "\u0001", 64

FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "entropy", "hex", "repeat", "vowels", "bigrams", "coverage", "announce", "deny", "assigned", "quoted", "known_prefix", "calm_path", "deep_path"]


def _held(*of) -> Column:
    """The last argument of the columns before it as a struct, worked out once and not at each use in a lambda."""
    return F.transform(F.array(F.struct(*of[:-1])), of[-1])[0]


def _ends(sizes: Column) -> Column:
    """0 and the running sums."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))


def _keys(p: Column) -> Column:
    """All key-like runs of a word from its runs, the gaps about them and the ends of both."""
    gap = lambda k: p["gaps"][k]
    return F.transform(p["runs"], lambda r, k: F.struct((p["ends"][k] + F.length(gap(k))).alias("offset"), (k == 0).alias("first"), F.right(gap(k), F.lit(NEAR)).alias("gap"), r.alias("run"), F.left(gap(k + 1), F.lit(8)).alias("after")))


def _told(p: Column) -> Column:
    """The announced values of a word from its marked parts and their ends."""
    n = F.size(p["t"])
    whole = lambda t, k: F.when(k == n - 1, F.concat_ws(" ", t, "follow")).otherwise(t)
    made = F.transform(
        p["t"],
        lambda t, k: F.struct(p["ends"][k].alias("offset"), (k == 1).alias("first"), F.right(F.get(p["t"], k - 1), F.lit(NEAR)).alias("gap"), F.regexp_extract(whole(t, k), f"^(?:{PEM}|{VALUE})", 0).alias("run"), F.lit("").alias("after")),
    )
    return F.slice(made, F.lit(2), n)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, row, path, place, offset, word, gap, run, before): one row for each candidate."""
    text = F.col(text_col)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    marked = F.regexp_replace(F.translate(text, MARK, "\u0002"), ANNOUNCED, "$0" + MARK)
    marked = F.regexp_replace(marked, f"{MARK}?({PEM})", MARK + "$1")
    base = docs.where(text.rlike(RUN) | text.rlike(ANNOUNCED) | text.rlike(PEM)).select(F.col(id_col).alias("doc_id"), row_hash(id_col, text_col).alias("row"), path.alias("path"), F.split(marked, r"\s+").alias("w"))
    found = base.withColumn("f", F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].contains(MARK) | (F.length(p["x"]) >= 16) & p["x"].rlike(RUN))).where(F.size("f") > 0)
    around = F.expr(f"transform(f, p -> struct(p.i as place, p.x as x, transform(slice(w, greatest(p.i - {AROUND} + 1, 1), least(p.i, {AROUND})), b -> right(b, {NEAR})) as before, array_join(transform(slice(w, p.i + 2, 6), b -> left(b, {NEAR})), ' ') as follow))")
    rows = found.select("doc_id", "row", "path", F.explode(around).alias("p")).select("doc_id", "row", "path", "p.*")
    rows = rows.withColumn("before", F.array_join(F.transform("before", lower_ascii), " "))
    plain = F.translate("x", MARK, "")
    parts = _held(F.split("x", MARK, -1).alias("t"), lambda p: _held(p["t"].alias("t"), _ends(F.transform(p["t"], F.length)).alias("ends"), _told))
    runs = _held(
        F.regexp_extract_all(plain, F.lit(RUN), F.lit(0)).alias("runs"),
        F.split(plain, RUN, -1).alias("gaps"),
        lambda p: _held(p["runs"].alias("runs"), p["gaps"].alias("gaps"), _ends(F.transform(p["runs"], lambda r, k: F.length(r) + F.length(p["gaps"][k]))).alias("ends"), _keys),
    )
    told = F.filter(parts, lambda c: (c["run"] != "") & ~c["run"].rlike(RUN))
    each = rows.select("doc_id", "row", "path", "place", "before", F.explode(F.concat(runs, told)).alias("c")).select("doc_id", "row", "path", "place", "before", "c.*")
    before = F.when(F.col("first") | ~F.col("gap").rlike("[A-Za-z]"), F.col("before")).otherwise("")
    return each.select("doc_id", "row", "path", "place", "offset", F.concat("gap", "run", "after").alias("word"), "gap", "run", before.alias("before"))


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("double")


def described(rows: DataFrame) -> DataFrame:
    """``rows`` (run, word, gap, before, path, coverage) with the features; gap is the word up to the run."""
    run, n = F.col("run"), F.length("run").cast("double")
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    lead = lower_ascii(F.regexp_extract("word", r"^([A-Za-z_\-]*)", 1))
    gap = lower_ascii(F.regexp_replace("gap", "([a-z])([A-Z])", "$1 $2"))
    context = F.concat_ws(" ", "before", gap, lead)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    has = lambda words: F.when(context.rlike(r"(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)"), 1.0).otherwise(0.0)
    path = lower_ascii(F.coalesce("path", F.lit("")))
    return rows.select(
        "*",
        n.alias("length"),
        (_count(run, "[0-9]") / n).alias("digits"),
        (_count(run, "[A-Z]") / n).alias("uppers"),
        (_count(run, "[a-z]") / n).alias("lowers"),
        (_count(run, "[+/_\\-]") / n).alias("others"),
        ((_count(run, "(?=[0-9][A-Za-z])") + _count(run, "(?=[A-Za-z][0-9])") + _count(run, "(?=[a-z][A-Z])") + _count(run, "(?=[A-Z][a-z])")) / n).alias("transitions"),
        (F.size(F.array_distinct(chars)) / n).alias("distinct"),
        F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)).alias("entropy"),
        F.when(run.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0).alias("hex"),
        (_count(run, r"(.)\1") / n).alias("repeat"),
        (_count(run, "[aeiouAEIOU]") / n).alias("vowels"),
        (_count(run, "(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt)") / n).alias("bigrams"),
        has(ANNOUNCE).alias("announce"),
        has(DENY).alias("deny"),
        F.when(F.concat_ws(" ", "before", "gap").rlike(r"[=:]>?\s*[\\\"'`]*$"), 1.0).otherwise(0.0).alias("assigned"),
        F.when(F.col("word").rlike("[\"'`]"), 1.0).otherwise(0.0).alias("quoted"),
        F.when(F.col("word").rlike(r"(^|[^A-Za-z0-9])(AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|-----BEGIN )"), 1.0).otherwise(0.0).alias("known_prefix"),
        F.when(path.rlike("|".join(CALM_PATHS)), 1.0).otherwise(0.0).alias("calm_path"),
        _count(path, "/").alias("deep_path"),
    )


def dictionary(docs: DataFrame, text_col: str = "text", common: float = COMMON) -> DataFrame:
    """(piece): words of 4 to 12 small letters that a share of the rows has."""
    w = docs.select(F.explode(F.array_distinct(F.split(lower_ascii(F.col(text_col)), "[^a-z]+"))).alias("piece")).where(F.length("piece").between(4, 12))
    least = max(3, math.ceil(common * docs.count()))
    return w.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("piece")


def covered(rows: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with coverage: the share of the run's characters that lie in a dictionary word."""
    split = lower_ascii(F.regexp_replace("run", "(?<=[a-z])(?=[A-Z])", " "))
    pieces = rows.select(*key, F.length("run").alias("n"), F.posexplode(F.regexp_extract_all(split, F.lit("[a-z]{4,}"), F.lit(0))).alias("at", "part"))
    places = pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("part") - 3)).alias("i"))
    parts = places.select(*key, "n", "at", "i", F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(12), F.length("part") - F.col("i") + 1)), lambda k: F.substring("part", F.col("i"), k))).alias("piece"))
    # the longest word from each place; then places that no earlier word reaches count
    reach = parts.join(words, "piece").groupBy(*key, "at", "i").agg(F.first("n").alias("n"), F.max(F.col("i") + F.length("piece")).alias("end"))
    before = F.coalesce(F.max("end").over(Window.partitionBy(*key, "at").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = reach.withColumn("new", F.greatest(F.col("end") - F.greatest(before, "i"), F.lit(0))).groupBy(*key).agg((F.sum("new") / F.first("n")).alias("coverage"))
    return rows.join(got, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings (word, before, path, label), the same each time."""
    h = lambda salt: F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)))
    base32 = F.upper(F.translate(F.concat(h("a"), h("b")), "01289", "GHJKQ"))
    mixed = F.concat(F.substring(F.translate(h("c"), "0123456789abcdef", "Qw7eRt2yUi9oPaS4"), 1, 20), F.substring(F.translate(h("d"), "0123456789abcdef", "zX3cVb8nM1kLjH5g"), 1, 20))
    # plain words, and words made of syllables by hash: prose may be in any tongue
    words = F.array(*[F.lit(w) for w in "the order there thing which under stream table value user account name handler update request buffer index version default module".split()])
    syllables = F.array(*[F.lit(x + y) for x in "bdfgklmnprstv" for y in "aeiou"])
    some = lambda of, salt: F.element_at(of, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(of)) + 1).cast("int"))
    made_up = lambda salt: F.concat(*[some(syllables, f"{salt}/{k}") for k in range(3)])
    pick = lambda salt: F.when(F.pmod(F.xxhash64("id", F.lit(salt + "?")), F.lit(3)) == 0, made_up(salt)).otherwise(some(words, salt))
    # where a finding was: half of all have no path; calm ones are more often harmless, but paths decide nothing alone
    paths = F.array(*[F.lit(x) for x in ("app/deploy.py", "conf/settings.ini", "src/ci/run.sh", "a/b/c.yaml", "web", "data/load.sql")])
    calm = F.array(*[F.lit(x) for x in ("test/unit.py", "docs/readme.md", "example/main.c", "spec/fixture.json")])
    chance = F.pmod(F.xxhash64("id", F.lit("path")), F.lit(100))
    place = lambda y: F.when(chance < 50, F.lit(None).cast("string")).when(chance < (62 if y else 80), some(calm, "calm")).otherwise(some(paths, "where"))
    joined = F.concat(pick("1"), pick("2"), pick("3"), pick("4"), F.substring(h("n"), 1, 1), F.lit("7"))
    num = F.translate(h("e"), "abcdef", "012345")
    q = F.lit('"')
    kinds: list[tuple[Column, Column, int]] = [
        (F.concat(F.lit("AKIA"), F.substring(base32, 1, 16)), F.concat_ws(" ", pick("5"), pick("6"), pick("7")), 1),
        (F.concat(F.lit("password="), F.substring(h("f"), 1, 18)), F.concat_ws(" ", pick("5"), pick("6")), 1),
        (F.concat(q, F.substring(F.concat(h("g"), h("h")), 1, 40), q), F.lit("token ="), 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat_ws(" ", pick("5"), F.lit("token:")), 1),
        (F.concat(q, mixed, q), F.lit("aws secret ="), 1),
        (F.concat(F.lit("api_key:"), F.substring(mixed, 1, 24)), pick("5"), 1),
        (F.substring(F.concat(h("g"), h("h")), 1, 40), F.lit("commit"), 0),
        (F.concat(F.lit("sha256:"), h("g"), h("h")), F.lit("digest"), 0),
        (F.concat_ws("-", F.substring(h("g"), 1, 8), F.substring(h("g"), 9, 4), F.substring(h("g"), 13, 4), F.substring(h("g"), 17, 4), F.substring(h("g"), 21, 12)), F.lit("uuid"), 0),
        (joined, F.concat_ws(" ", pick("5"), pick("6"), pick("7")), 0),
        (F.concat(F.lit("https://www."), pick("1"), F.lit(".com/"), joined, F.lit("/"), F.substring(num, 1, 5)), pick("6"), 0),
        (F.substring(num, 1, 20), F.concat_ws(" ", pick("5"), pick("6")), 0),
        (F.concat(F.lit("2024-"), F.substring(num, 1, 2), F.lit("-"), F.substring(num, 3, 2), F.lit("T"), F.substring(num, 5, 2), F.lit("-"), F.substring(num, 7, 6)), F.lit("at"), 0),
        (F.concat(F.lit("password="), F.repeat(F.substring(h("f"), 1, 1), 12), F.lit("1234")), F.lit("example"), 0),
        (F.concat(F.lit("AKIA"), F.lit("EXAMPLEEXAMPLE00")), F.concat_ws(" ", pick("5"), F.lit("sample")), 0),
        (F.concat(pick("1"), F.lit("_"), pick("2"), F.lit("_"), pick("3"), F.lit("_v2")), F.lit("file"), 0),
    ]
    short = F.concat(F.substring(mixed, 1, 5), F.substring(h("i"), 1, 4))
    plain = F.concat(pick("8"), F.substring(num, 1, 3))
    pem = F.concat(F.lit("-----BEGIN "), F.element_at(F.array(*[F.lit(x) for x in ("", "RSA ", "EC ", "OPENSSH ")]), (F.col("id") % 4 + 1).cast("int")), F.lit("PRIVATE KEY-----"))
    stub = F.element_at(F.array(*[F.lit(x) for x in ("none", "null", "true", "required", "********", "xxxxxxxx", "${TOKEN}", "string", "changeme", "todo")]), (F.pmod(F.xxhash64("id"), F.lit(10)) + 1).cast("int"))
    # announced below the bar, and runs that are one of many in a word: (gap, run, after, before, label)
    told: list[tuple[Column, Column, Column, Column, int]] = [
        (F.lit("password="), short, F.lit(""), pick("5"), 1),
        (F.lit('","secret":"'), F.substring(mixed, 1, 12), F.lit('"}'), F.lit(""), 1),
        (F.lit(""), plain, F.lit(""), F.concat_ws(" ", pick("5"), F.lit("password:")), 1),
        (F.lit(""), pem, F.lit(""), F.lit(""), 1),
        (F.lit('{"id":"'), F.concat(F.lit("AKIA"), F.substring(base32, 1, 16)), F.lit('","secre'), F.lit(""), 1),
        (F.lit('","secret":"'), mixed, F.lit('"}'), F.lit(""), 1),
        (F.lit(";key="), F.substring(mixed, 1, 32), F.lit(";"), F.lit(""), 1),
        (F.lit("token:"), pick("8"), F.lit(""), pick("5"), 0),
        (F.lit(""), pick("8"), F.lit(""), F.concat_ws(" ", pick("5"), F.lit("key:")), 0),
        (F.lit("password="), stub, F.lit(""), pick("5"), 0),
        (F.lit('"token":"'), stub, F.lit('"'), F.lit(""), 0),
        (F.lit("key="), F.substring(num, 1, 3), F.lit(""), pick("5"), 0),
        (F.lit('","sha1":"'), F.substring(F.concat(h("g"), h("h")), 1, 40), F.lit('","'), F.lit(""), 0),
        (F.lit('","path":"'), F.concat(F.lit("/usr/"), joined, F.lit("/"), pick("6")), F.lit('","'), F.lit(""), 0),
    ]
    runs = lambda w: F.regexp_extract_all(w, F.lit(RUN), F.lit(0))
    longest = lambda w: F.element_at(F.reverse(F.array_sort(F.transform(runs(w), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))), 1)["r"]
    case = F.array(
        *[F.struct(w.alias("word"), F.lit(None).cast("string").alias("gap"), F.lit(None).cast("string").alias("run"), b.alias("before"), place(y).alias("path"), F.lit(float(y)).alias("label")) for w, b, y in kinds],
        *[F.struct(F.concat(g, r, a).alias("word"), g.alias("gap"), r.alias("run"), b.alias("before"), place(y).alias("path"), F.lit(float(y)).alias("label")) for g, r, a, b, y in told],
    )
    made = spark.range(min(rows, TRAIN)).select("id", F.element_at(case, (F.col("id") % (len(kinds) + len(told)) + 1).cast("int")).alias("k")).select(F.col("id").alias("row"), "k.*")
    made = made.withColumn("run", F.coalesce("run", F.when(F.size(runs(F.col("word"))) > 0, longest(F.col("word"))))).where("run is not null")
    return made.withColumn("gap", F.coalesce("gap", F.expr("substring_index(word, run, 1)"))).withColumn("before", lower_ascii(F.col("before")))


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(rows))


def train(labelled: DataFrame, words: DataFrame, seed: int = 7) -> RandomForestClassificationModel:
    """The forest from labelled findings (row, word, run, before, path, label)."""
    if "gap" not in labelled.columns:
        labelled = labelled.withColumn("gap", F.expr("substring_index(word, run, 1)"))
    rows = covered(labelled.orderBy(F.xxhash64("row"), "row").limit(TRAIN), words, ["row"])
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(_vector(rows).select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, place, offset, length, run_sha256, score, is_secret) of every candidate."""
    stash = Stash(docs.sparkSession, "secrets")
    rows = stash.put(candidates(docs, id_col, text_col, path_col), "candidates")
    # coverage is a matter of the run alone
    runs = stash.put(covered(rows.select("run").distinct(), words, ["run"]), "covered")
    known = _vector(rows.join(runs, "run")).select("doc_id", "place", "offset", F.length("run").alias("length"), F.sha2("run", 256).alias("run_sha256"), "features")
    known = stash.put(known, "described")
    # the runs and the words around them were in clear: nothing but hashes and numbers is left
    stash.keep("described")
    judged = model.transform(known)
    score = F.round(vector_to_array("probability")[1], 6)
    return judged.select("doc_id", "place", "offset", "length", "run_sha256", score.alias("score"), (score >= 0.5).alias("is_secret"))


def scan_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Dictionary, training on ``findings`` and scan of all texts."""
    spark = docs.sparkSession
    stash = Stash(spark, "secret-words")
    words = stash.put(dictionary(docs, text_col), "words")
    labelled = stash.put(findings(spark), "findings")
    found = scan(docs, train(labelled, words), words, id_col, text_col, path_col)
    stash.keep()
    return found
