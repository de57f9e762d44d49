"""Positional inverted index of documents, and exact phrase and proximity matches of test items in it. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, texts_of, written

#: What separates words, before and after A-Z are lowered.
BREAKS, LOWERED_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["document", "text_hash"]
MATCH = [*KEY, "window", "start"]


def named(docs: DataFrame) -> DataFrame:
    """Documents with what names them in the index: `document` (the id, 0 for null) and `text_hash`, so rows of one id and one text are one
    document there, and rows of one id with other texts are others."""
    texts = texts_of(docs)
    mark = F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    return texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("document"), mark.alias("text_hash"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """`item_id` (text; null: the empty string), `window` and `terms`: runs of `size` words, or the whole of a shorter item with words."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), LOWERED_BREAKS), lambda w: w != "")
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("terms")).select(
        "item_id", F.xxhash64("terms").alias("window"), "terms").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings, one row for each occurrence: `doc_id`, `text_hash`, `position`, `term` (hash of the word).

    The index is stored in the order of the documents, each task writing those it reads, so building it shuffles nothing. With `vocabulary`
    (column `word`) only the postings of these words are stored: those of other words are in no list that its test items would intersect.
    """
    word = F.when(F.col("word").rlike("[A-Z]"), F.translate("word", UPPER, LOWER)).otherwise(F.col("word"))
    found = named(docs).select(*KEY, F.posexplode(F.split("text", BREAKS)).alias("position", "word")).withColumn("word", word)
    found = found.filter("word <> ''") if vocabulary is None else found.join(vocabulary.select("word"), "word", "left_semi")
    return written(found.select(*KEY, "position", F.xxhash64("word").alias("term")), "postings")


def rank_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """The terms of each distinct window from the rarest on: `window`, `size`, `place`, `term`, `rank`. Windows with an unseen term go."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = windows.dropDuplicates(["window"]).select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "word"))
    own = Window.partitionBy("window")  # as many rows as a window has words
    ranked = terms.withColumn("term", F.xxhash64("word")).join(counts, "term", "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(own))
    rank = F.row_number().over(own.orderBy("n", "place"))
    return written(ranked.filter("least > 0").withColumn("rank", rank).select("window", "size", "place", "term", "rank"), "windows")


def intersect(found: DataFrame, lists: DataFrame, index: DataFrame, slack: int) -> DataFrame:
    """Of the matches so far those whose next terms stand where the match wants them, at most `slack` words beside.

    One shuffle by the wanted posting, which keeps hot documents and hot terms apart, and one by match. A repeated posting counts once.
    """
    moves = F.sequence(F.lit(-slack), F.lit(slack))
    wanted = found.join(lists, "window").select(*MATCH, "size", "place", "term", "terms", F.explode(moves).alias("move")).withColumn(
        "position", F.col("start") + F.col("place") + F.col("move"))
    met = wanted.join(index, [*KEY, "position", "term"], "left_semi")
    return met.groupBy(*MATCH, "size", "terms").agg(F.count_distinct("place").alias("met")).filter("met = terms").select(*MATCH, "size")


def matches(index: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """Where windows occur: `doc_id`, `text_hash`, `window`, `start`, `size`; each once.

    `slack` 0 gives exact phrases; above it proximity matches, in which each term stands at most so many words beside the place that the
    window's rarest term (`start` is reckoned from it) gives it. The list of the rarest term, less its place in the window, is the first set
    of starts. It is intersected with the second-rarest term's list, and what is left with all others, which are read for the documents
    left only.
    """
    first = ranked.filter("rank = 1").select("window", "size", "place", "term")
    starts = index.join(first, "term").select(*KEY, "window", (F.col("position") - F.col("place")).alias("start"), "size").distinct()
    second = ranked.filter("rank = 2").select("window", "place", "term", F.lit(1).alias("terms"))
    of_second = index.join(second.select("term").distinct(), "term", "left_semi")
    alone = starts.filter("size = 1")
    twice = written(intersect(starts.filter("size > 1"), second, of_second, slack), "starts")
    rest = ranked.filter("rank > 2").select("window", "place", "term", (F.col("size") - 2).alias("terms"))
    left = index.join(written(twice.filter("size > 2").select(*KEY).distinct(), "documents-left"), KEY, "left_semi")
    return alone.unionByName(twice.filter("size = 2")).unionByName(intersect(twice.filter("size > 2"), rest, left, slack))


def covered_words(found: DataFrame) -> DataFrame:
    """Words inside any match, by document: what each match adds beyond the end of those that start before it."""
    spans = found.select(*KEY, "start", (F.col("start") + F.col("size")).alias("end")).groupBy(*KEY, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # at most a row for each word
    added = spans.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("added", F.greatest(F.lit(0), F.col("end") - F.greatest("before", "start")))
    return added.groupBy(*KEY).agg(F.sum("added").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Words of every document that stand in an occurrence of an item's window, and the items found.

    One row for each row of `docs`: repeated rows get the same result, rows of one id with other texts their own, null ids theirs. Null and
    empty texts have no words; items without words have no windows; a null item_id counts as the empty string, an item_id with several texts
    as one item. Without items or documents nothing is found. Other columns are not read, whatever their names. Texts are not shuffled:
    postings are, by document, position and term. A window whose rarest term is frequent has long lists, which are intersected in full.
    """
    windows = written(item_windows(items, size), "item-windows")
    vocabulary = written(windows.select(F.explode("terms").alias("word")).distinct(), "vocabulary")
    index = build_index(docs, vocabulary)
    found = written(matches(index, rank_terms(windows, index)), "matches")
    ids = found.select(*KEY, "window").distinct().join(windows.select("window", "item_id"), "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hits = written(covered_words(found).join(ids, KEY), "hits")
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    every = named(docs).select("doc_id", *KEY, count.alias("n_words"))
    return every.join(hits, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def decontaminate_sql(size: int = 10) -> str:
    """DuckDB SQL for `decontaminate` over `documents` and `benchmark`, by comparing every run of words; doc_ids are taken as unique."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, list_slice(w, s, s + {size - 1}) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(k) AS n FROM windows),
runs AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
found AS (SELECT DISTINCT doc_id, s, n, item_id FROM runs JOIN windows USING (k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS listed FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""
