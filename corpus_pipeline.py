"""Documents to training tokens, in five stages; each works on what the one before
it kept, and applies an operator of voxmill.llm with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import materialize, table, tidied
from voxmill.llm.decontaminate import decontaminate
from voxmill.llm.mixing import mix, times_taken
from voxmill.llm.near_dedup import near_duplicates
from voxmill.llm.quality import keep_good
from voxmill.llm.token_binary import token_binary


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows of gone (doc_id, copy); copy is the hash of their text."""
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct(), name)
    docs = docs.select(F.struct(*docs.columns).alias("d"), F.xxhash64("text").alias("own"))
    return docs.join(gone, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_copy")), "left_anti").select("d.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score of 0.5 or more. Null texts
    are scored as empty ones; equal rows stay or go together; without labels, or with
    good ones alone, all stay; an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8), that of the
    least doc_id. Null and empty texts have no copies and stay. Rows of one doc_id are
    told apart by their texts; those that are equal in both, or are in one group under
    one doc_id, stay or go together. A null doc_id goes where its group has another one.
    An empty table stays empty."""
    found = near_duplicates(docs).withColumn("kept", F.col("kept") & (F.col("doc_id").isNotNull() | F.col("component_id").isNull()))
    return _without(docs, found.where("not kept"), "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows do not hold a twentieth of the words. Null
    and empty texts stay; rows are found by doc_id, null or not, and text, so equal rows
    go together and others of their doc_id stay; without benchmark all stay; an empty
    table stays empty."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), "contaminated")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its words over their size, rounded so
    that each source comes near its target and no document goes in more than 3 times.
    Documents without words are not taken; a null source is a source; equal rows are
    taken equally often; an empty table stays empty."""
    times = times_taken(mix(docs)["rows"]).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("source").alias("_source"), F.col("times").cast("int").alias("_times"))
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.xxhash64("text").alias("own"))
    same = F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_copy")) & F.col("d.source").eqNullSafe(F.col("_source"))
    taken = rows.join(materialize(times, "taken"), same)
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("d.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, read back: (doc_id, start, n_tokens, ids_crc32). Null texts are
    empty ones, which have their end id; null doc_ids come first, rows of one doc_id in
    the order of their texts; an empty table gives no rows."""
    return token_binary(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Learned rules, near duplicates and encoding are beyond SQL; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidied(spark):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
