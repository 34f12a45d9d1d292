"""Named queries of the operators here, over whole tables, and the SQL that checks those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import edit_embed, langid, licenses, merge_table, mixing, near_dup, quality, substring, toxicity
from gleanery.llm.common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embed.edited_pairs(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_table.token_counts(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the significant passages of each document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("slots")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_table.encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_license_scan, op3_language_id, op4_edit_fingerprints, op5_token_counts,
        op6_quality_rules, op7_toxicity, op8_mix, op9_substring_dedup, op10_sentencepiece,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": near_dup.ORACLE, "op8_mix": mixing.ORACLE, "op9_substring_dedup": substring.ORACLE}
