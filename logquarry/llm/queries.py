"""The queries of the corpus operators over whole tables, with production parameters, and SQL for those that have some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, flac, html_text, language, line_templates, mixing, quality, simhash, warc
from .common import table


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.record_digests(warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), *tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_html_text, op3_flac, op4_line_templates, op5_language, op6_warc, op7_chat, op8_simhash, op9_mixing, op10_byte_bpe)
}

#: Fingerprints, seeded selection, codecs and models are beyond SQL; tests/llm holds their brute-force versions.
ORACLE_SQL: dict[str, str] = {}
