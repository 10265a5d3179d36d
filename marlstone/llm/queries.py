"""The registered queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import chat, class_lm, decontamination, language, line_dedup, near_dup, packing, quality, rules, token_files
from marlstone.llm.common import read


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(read(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_segments(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_quality, op4_line_dedup, op5_language, op6_near_dup, op7_rules, op8_token_files, op9_class_lm, op10_chat)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontamination.ORACLE, "op7_rules": rules.ORACLE, "op10_chat": chat.ORACLE}
