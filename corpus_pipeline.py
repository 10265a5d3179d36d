"""The corpus pipeline: language, repeated lines, near copies, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, decontamination, language, line_dedup, near_dup, packing, queries

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learnt language go."""
    return language.drop_unidentified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out; documents of which nothing remains go."""
    return line_dedup.remove_repeats(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, also one in which single words were added or left out."""
    return decontamination.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"), slop=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification is a trained model: SQL can't express the pipeline's rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
