"""Benchmark decontamination on a distributed positional inverted index.

The index holds, for the terms asked of it, one posting (term, row, position) for each occurrence in
the training texts. A phrase is searched from its rarest terms: their postings, moved back by the
terms' offsets in the phrase, are intersected, and what is left is confirmed on the text. Proximity
search asks for all terms of an item within a span, again from its rarest term.

Terms' document frequencies are counted over all texts (only the benchmark's vocabulary is kept),
so "rarest" holds for the corpus and the postings stored are few. Everything is DataFrame
expressions; there is no Python on the data path.

Scale. Tokens are joined against the benchmark's terms where they are made, so common words never
leave their task; counts are summed map-side. Postings of the chosen terms are dealt by (row, term,
place), so no term or row is hot. The benchmark's tables are broadcast up to ``SEND_ROWS`` rows, else joined by
shuffle. The index names rows by a 64-bit hash: rows of equal hash share candidates, and the exact check
on each text parts them. Texts of rows with a candidate move to be confirmed; a row's candidate starts are bounded by its
length times the windows that start with the same terms. Items are joined to what is confirmed, one row for each window of a text
and owner of the window, so owners are never gathered. Shared passages add postings in
proportion to their copies only.

Defined cases: null has no words; an item without words has no window; an item of fewer words than
a window is one; repeated items count under each of their ids, an item with a null id under none; repeated rows are judged each; ties of
term frequency are broken by the term; an empty benchmark leaves every document clean, and an empty table gives an
empty result. Ids may be of any type. Extra columns pass through; those named like a result (n_words, n_hit, spans,
items) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Stash, lower_ascii, row_hash, row_keys

#: Words are the maximal runs of what is left: digits, letters a-z and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists intersected for a window: its rarest terms.
LISTS = 3
SEND_ROWS = 500_000


def words(col: str | Column) -> Column:
    """Lower-cased words of a text; null has none."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_remove(F.split(lower_ascii(col.cast("string")), BETWEEN), ""), F.array().cast("array<string>"))


def send(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SEND_ROWS else df


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(win, terms) of the distinct windows, and (win, item) of the items that have them."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    each = each.withColumn("win", F.md5(F.array_join("terms", " ")))
    return each.select("win", "terms").dropDuplicates(["win"]), each.select("win", "item").distinct()


def tokens(docs: DataFrame, row: str, text_col: str) -> DataFrame:
    """(row, pos, term) of all occurrences, positions from 0."""
    return docs.select(row, F.posexplode(words(text_col)).alias("pos", "term"))


def frequencies(docs: DataFrame, vocabulary: DataFrame, row: str, text_col: str) -> DataFrame:
    """(term, df): occurrences over the whole corpus of the vocabulary's terms."""
    seen = tokens(docs, row, text_col).select("term").join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    return vocabulary.join(seen, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def postings(docs: DataFrame, terms: DataFrame, row: str, text_col: str) -> DataFrame:
    """The inverted index of these terms: (term, row, pos)."""
    return tokens(docs, row, text_col).join(terms, "term").select("term", row, "pos")


def plan_windows(wins: DataFrame, df: DataFrame, lists: int = LISTS) -> DataFrame:
    """(win, n, term, offset, lists): each window's rarest terms at their first offsets."""
    at = wins.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
    at = at.groupBy("win", "n", "term").agg(F.min("offset").alias("offset")).join(df, "term")
    rank = Window.partitionBy("win").orderBy("df", "term")  # a window has ten terms at most
    at = at.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= lists)
    return at.withColumn("lists", F.count("*").over(Window.partitionBy("win"))).select("win", "n", "term", "offset", "rank", "lists")


def phrase_hits(docs: DataFrame, wins: DataFrame, stash: Stash, row: str = "_row", text_col: str = "text") -> DataFrame:
    """Candidates (row, win, start): windows whose rarest terms all stand at their places."""
    vocabulary = stash.put(wins.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    n_terms = vocabulary.count()
    df = stash.put(frequencies(docs, send(vocabulary, n_terms), row, text_col), "frequencies")
    plan = stash.put(plan_windows(wins, df), "plan")
    chosen = plan.select("term").distinct()
    # the stored index: one scan, one posting for each occurrence of a chosen term
    index = stash.put(postings(docs, send(chosen, n_terms), row, text_col), "postings")
    n_plan = plan.count()
    # the rarest list leads; each of its places asks the other lists at their offsets
    lead = index.join(send(plan.where("rank = 1").select("win", "term", "offset", "lists"), n_plan), "term")
    lead = lead.select(row, "win", "lists", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    others = plan.where("rank > 1").select("win", "term", "offset")
    asked = lead.where("lists > 1").join(send(others, n_plan), "win").withColumn("pos", F.col("start") + F.col("offset"))
    met = asked.join(index, [row, "term", "pos"], "left_semi").groupBy(row, "win", "start", "lists").agg(F.count("*").alias("got"))
    # rows equal in every column share a key and count together; what that lets through the exact check ends
    return met.where("got >= lists - 1").select(row, "win", "start").union(lead.where("lists = 1").select(row, "win", "start").distinct())


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, spans array<struct<start, stop>> of the occurrences and items (sorted item ids)."""
    stash = Stash(docs.sparkSession, "decontam")
    wins, owners = windows(items, size, item_id, item_text)
    wins, owners = stash.put(wins, "windows"), stash.put(owners.where("item is not null"), "owners")
    n_wins = wins.count()
    docs = docs.drop(*({"n_words", "n_hit", "spans", "items"} - {id_col, text_col}))
    keys = row_keys(id_col, text_col)
    narrow = docs.select(*(k.alias(c) for c, k in keys.items()), row_hash(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    found = stash.put(phrase_hits(narrow, wins, stash, "_row", "_text").join(send(wins, n_wins), "win"), "candidates")
    asked = stash.put(found.select("_row").distinct(), "asked")
    texts = narrow.join(send(asked, asked.count()), "_row", "left_semi").dropDuplicates(list(ROW))
    each = stash.put(found.groupBy("_row").agg(F.collect_list(F.struct("start", "terms", "win")).alias("_found")), "each")
    # the exact check: the window stands in the text, word by word
    sure = F.filter("_found", lambda x: F.slice("_words", x["start"] + 1, F.size(x["terms"])) == x["terms"])
    rows = texts.join(each, "_row").withColumn("_words", words("_text")).withColumn("_sure", sure).where(F.size("_sure") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("_sure", lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.size(x["terms"])).alias("stop")))))
    rows = stash.put(rows.select(*ROW, spans.alias("spans"), F.array_distinct(F.transform("_sure", lambda x: x["win"])).alias("wins")), "sure")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["stop"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end")),
        lambda acc: acc["n"],
    )
    met = rows.select(*ROW, F.explode("wins").alias("win")).join(send(owners, owners.count()), "win").groupBy(*ROW).agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = stash.put(rows.select(*ROW, "spans", covered.alias("n_hit")).join(met, list(ROW), "left"), "judged")
    stash.keep("judged")
    # words are counted before the join: a text that isn't asked for needn't move
    out = docs.withColumns(keys | {"n_words": F.size(words(text_col)).cast("long")}).join(judged, list(ROW), "left").drop(*ROW)
    return out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )


def proximity(docs: DataFrame, items: DataFrame, span: int, terms: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start): places of an item's rarest term with all its distinct terms within ``span`` consecutive words.

    The ``terms`` rarest terms give the candidates: each of them has to have a posting less than
    ``span`` words from ``start``, found by slices of positions, so no two lists are multiplied out. All
    terms of the item are then looked for on the text."""
    stash = Stash(docs.sparkSession, "proximity")
    narrow = docs.select(row_hash(id_col, text_col).alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = stash.put(items.select(F.col(item_id).alias("item_id"), F.array_distinct(words(item_text)).alias("terms")).where(F.size("terms") > 0).dropDuplicates(), "wanted")
    wanted = stash.put(wanted.withColumn("k", F.md5(F.to_json(F.struct("item_id", "terms")))), "items")
    each = wanted.select("k", F.explode("terms").alias("term"))
    vocabulary = stash.put(each.select("term").distinct(), "vocabulary")
    df = stash.put(frequencies(narrow, send(vocabulary, vocabulary.count()), "_row", "text"), "frequencies")
    rank = Window.partitionBy("k").orderBy("df", "term")
    plan = each.join(df, "term").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= terms)
    plan = stash.put(plan.withColumn("need", F.count("*").over(Window.partitionBy("k"))).select("k", "term", "rank", "need"), "plan")
    chosen = plan.select("term").distinct()
    index = stash.put(postings(narrow, send(chosen, chosen.count()), "_row", "text"), "postings").join(send(plan, plan.count()), "term")
    slot = (F.col("pos") / span).cast("int")
    lead = index.where("rank = 1").select("_row", "k", "need", F.col("pos").alias("start"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    rest = index.where("rank > 1").groupBy("_row", "k", "rank", slot.alias("slot")).agg(F.sort_array(F.collect_set("pos")).alias("at"))  # span places at most
    near = lead.join(rest, ["_row", "k", "slot"]).where(F.exists("at", lambda p: F.abs(p - F.col("start")) < span))
    full = near.groupBy("_row", "k", "need", "start").agg(F.count_distinct("rank").alias("got")).where("got = need - 1").select("_row", "k", "start")
    found = stash.put(full.union(index.where("need = 1").select("_row", "k", F.col("pos").alias("start"))).distinct().join(send(wanted, wanted.count()), "k"), "found")
    rows = narrow.join(found, "_row").withColumn("w", words("text"))
    # a span of words that has the rarest term at start and all the others somewhere
    begins = F.sequence(F.greatest(F.col("start") - span + 1, F.lit(0)), F.col("start"))
    there = F.get("w", F.col("start")).isNotNull() & F.exists(begins, lambda b: F.size(F.array_except("terms", F.slice("w", b + 1, span))) == 0)
    return rows.where(there).select("doc_id", "item_id", "start")
