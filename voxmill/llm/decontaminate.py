"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of `size` words (an item of fewer words is one
window). A window can only stand where all its words stand, so one word of each
window, its prefix, is enough to find every place: the rarest one, with ranks
from the counts of the benchmark's words over all documents. Document words are
joined with the prefixes; the window's length and the prefix's place in it bound
where it would start; its second rarest word and then all its words are compared.

Windows are broadcast only while `broadcast_windows` bounds their number. Beyond
it the same join runs as a shuffle, with the words around each place carried along.
A bitmap of the prefixes' hashes, of fixed size, is broadcast for it, so only words
that may be prefixes are carried; common prefixes are left to the skew-join handling
of Spark.

Rows: null and empty texts have no words; a null doc_id is a document; rows equal
in doc_id and text are one document; items that are null or without words, and a
benchmark without rows, match nothing; an item with a null id hits words and is not
counted among the items; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import lower_ascii, materialize

#: Between words: ASCII other than 0-9 and, after lower-casing, a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, HIT_SHARE, BROADCAST_WINDOWS = 13, 20, 200_000
#: Words of 64 bits in the bitmap of prefixes: 2 MB of bits, whatever their number.
BITMAP_ROWS = 1 << 18


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAPS), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window array<string>, items array): the distinct windows of all items."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return (
        w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window"))
        .groupBy("window").agg(F.collect_set("item_id").alias("items"))
    )


def ranked_windows(documents: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Adds each window's two rarest words and their places in it."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    every = documents.select(F.explode(words(F.col("text"))).alias("word"))
    if _bounded(vocabulary, broadcast_windows):
        counts = every.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:  # counted before they are shuffled, so a frequent word is a row for each task
        counts = every.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    placed = windows.select("window", "items", F.posexplode("window").alias("place", "word")).join(counts, "word", "left")
    ranks = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")))
    return (
        placed.groupBy("window").agg(F.first("items").alias("items"), ranks.alias("r"))
        .where(F.col("r")[0]["n"] > 0)
        .select("window", "items", F.size("window").alias("len"), F.col("r")[0]["word"].alias("word"), F.col("r")[0]["place"].alias("place"),
                F.get("r", F.lit(1))["word"].alias("word2"), F.get("r", F.lit(1))["place"].alias("place2"))
    )


def _bounded(windows: DataFrame, bound: int = BROADCAST_WINDOWS) -> bool:
    return windows.limit(bound + 1).count() <= bound


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, copy (the hash of its text), n_words, n_hit, items (ids with
    windows in it) and contaminated (hits are at least a HIT_SHARE-th of its words)."""
    documents = documents.select("doc_id", "text")
    windows = materialize(item_windows(benchmark, size), "windows")
    windows = materialize(ranked_windows(documents, windows, broadcast_windows), "ranked")
    # size() of null is -1 in sessions without ANSI
    w = documents.select("doc_id", F.xxhash64("text").alias("copy"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    start = F.col("pos") - F.col("place")
    here = F.col("word2").isNull() | (F.get("w", start + F.col("place2")) == F.col("word2"))
    fits = (start >= 0) & (start + F.col("len") <= F.size("w"))
    same = F.slice("w", start + 1, F.col("len")) == F.col("window")
    if _bounded(windows, broadcast_windows):
        found = (
            w.select("*", F.posexplode_outer("w").alias("pos", "word"))
            .join(F.broadcast(windows), "word", "left")
            .select("doc_id", "copy", F.coalesce(F.size("w"), F.lit(0)).alias("n"), "pos", F.when(fits & here, F.when(same, F.struct(start.alias("start"), (start + F.col("len")).alias("end"), "items"))).alias("hit"))
            .where(F.col("hit").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
        )
    else:
        around = F.slice("w", F.greatest(F.col("pos") - (size - 2), F.lit(1)), 2 * size)
        spotted = lambda rows: rows.withColumn("at", F.pmod(F.xxhash64("word"), F.lit(64 * BITMAP_ROWS))).selectExpr("*", "at div 64 AS spot", "cast(at % 64 AS int) AS bit")
        bits = spotted(windows.select("word")).groupBy("spot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        placed = spotted(w.select("*", F.posexplode("w").alias("pos", "word"))).join(F.broadcast(bits), "spot").where(F.expr("getbit(bits, bit) = 1"))
        placed = placed.select("doc_id", "copy", "pos", "word", F.size("w").alias("n"), around.alias("around"))
        at = start - F.greatest(F.col("pos") - (size - 1), F.lit(0))
        hits = (
            placed.join(windows, "word").where((start >= 0) & (start + F.col("len") <= F.col("n")))
            .where(F.slice("around", at + 1, F.col("len")) == F.col("window"))
            .select("doc_id", "copy", "n", F.struct(start.alias("start"), (start + F.col("len")).alias("end"), "items").alias("hit"))
        )
        found = hits.unionByName(w.select("doc_id", "copy", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit")))
    spans = F.sort_array(F.collect_set(F.when(F.col("hit").isNotNull(), F.struct(F.col("hit.start"), F.col("hit.end")))))
    # spans in order: each adds what lies beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    return (
        found.groupBy("doc_id", "copy").agg(F.max("n").cast("long").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("hit.items"))).alias("items"))
        .select("doc_id", "copy", "n_words", covered.cast("long").alias("n_hit"), "items")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
    )


def digest(result: DataFrame) -> DataFrame:
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos, lens WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
