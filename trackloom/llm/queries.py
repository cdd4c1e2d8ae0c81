"""One query for each operator of this subpackage, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import chat, credentials, divergence, infill, near, packed, personal, pieces, preference, rules, shards, suffix, templates
from trackloom.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.query(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.query(table(spark, sf_dir, "documents"))


def op3_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.score(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query(table(spark, sf_dir, "documents"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.written_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), shards.LIMIT)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_secret_scan, op3_suffix_tree_score, op4_quality_rules, op5_template_decontamination,
        op6_sentencepiece, op7_chat_format, op8_quality_classifier, op9_packed_tokens, op10_extendible_shards,
        op11_fill_in_middle, op12_source_divergence, op13_personal_data,
    )
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": rules.ORACLE, "op7_chat_format": chat.ORACLE, "op10_extendible_shards": shards.ORACLE, "op11_fill_in_middle": infill.ORACLE,
    "op12_source_divergence": divergence.ORACLE, "op13_personal_data": personal.ORACLE,
}
