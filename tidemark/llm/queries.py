"""Queries of this subpackage: name -> (function of session and folder, oracle statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, linededup, mixing, neardup, neighbours, ngramjoin, packing, phrases, pseudonyms, quality, repair, toxicity, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _over(name: str, operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(table(spark, folder, name))


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_bands(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": _over("documents", linededup.line_dedup),
    "op2_chat_format": _over("conversations", chat.chat_format),
    "op3_mixing": _over("documents", mixing.mixing),
    "op4_packing": _over("documents", packing.packing),
    "op5_pseudonyms": _over("documents", pseudonyms.pseudonyms),
    "op6_near_duplicates": _over("documents", neardup.near_duplicates),
    "op7_url_filter": _over("pages", urls.url_filter),
    "op8_neighbours": _over("embeddings", neighbours.neighbours),
    "op9_toxicity": toxicity_query,
    "op10_compression_bands": quality_query,
    "op11_ngram_join": _over("documents", ngramjoin.jaccard_components),
    "op12_conversation_repair": _over("conversations", repair.damaged_and_repaired),
    "op13_phrases": _over("documents", phrases.collocations),
}
SQL: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE, "op2_chat_format": chat.ORACLE, "op7_url_filter": urls.ORACLE, "op11_ngram_join": ngramjoin.ORACLE,
    "op12_conversation_repair": repair.ORACLE, "op13_phrases": phrases.ORACLE,
}
