"""Queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, hostrules, knnquality, langid, linededup, mixing, neardup, spm, urlfilter
from .common import table


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(urlfilter.label_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label_spans(docs, langid.fit(docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"))


def op7_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knnquality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_templates,
        op2_source_mixing,
        op3_language_spans,
        op4_simhash_near_dedup,
        op5_host_quality_rules,
        op6_sentencepiece,
        op7_multi_index_neighbours,
        op8_chat_formatting,
        op9_neighbour_quality,
        op10_fuzzy_line_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op1_url_templates": urlfilter.sql(),
    "op2_source_mixing": mixing.sql(),
    "op5_host_quality_rules": hostrules.sql("doc_id, host, n_failed::INTEGER AS n_failed, host_rate_ppm, host_verdict, keep"),
    "op8_chat_formatting": chat.sql(),
}
