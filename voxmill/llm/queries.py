"""The registered queries of these operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import alignment, chat, decontaminate, merkle, mixing, near_dedup, pieces, pii, quality, repeats, search, token_binary, token_counts
from voxmill.llm.common import table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_binary(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))["documents"]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.write_and_read(chat.with_conflict(table(spark, sf_dir, "conversations")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("copy")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return search.search(documents, search.sampled_queries(documents))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode_pieces(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_near_dedup, op3_token_counts, op4_suffix_dedup, op5_token_binary,
        op6_chat_format, op7_mixing, op8_pii, op9_search, op10_quality,
        op11_token_alignment, op12_merkle_manifest, op13_sentencepiece,
    )
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op4_suffix_dedup": repeats.ORACLE,
    "op6_chat_format": chat.ORACLE, "op7_mixing": mixing.ORACLE, "op9_search": search.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
