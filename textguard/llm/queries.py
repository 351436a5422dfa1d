"""The registered queries of the training-data operators, with production
parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textguard.llm import html_main, imatch, lang_crf, mixing, near_dedup, paragraph_dedup, pieces, quality_net, quality_rules, url_trees, vector_codes, whitening, winnowing
from textguard.llm.common import table


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.identify(table(spark, sf_dir, "documents"))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op9_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge_urls(table(spark, sf_dir, "pages"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_crf, op2_curriculum_mix, op3_quality_rules, op4_repeated_passages, op5_near_duplicates,
        op6_imatch, op7_main_text, op8_sentencepiece, op9_quality_network, op10_url_trees,
        op11_winnowing, op12_vector_codes, op13_whitening,
    )
}
