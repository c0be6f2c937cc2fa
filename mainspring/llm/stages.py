"""The stages of the corpus pipeline, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, language, mixing, secrets, simhash
from ._common import drop_materialised, materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts, texts without a letter, and texts whose language is ambiguous.

    The rule is that of language.keep_known(); rows are judged one by one, whatever their ids,
    repeats and other columns.
    """
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, by the rule of simhash.one_of_each()."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose text holds a benchmark item, by the rule of decontam.decontaminate()."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, by the rule of secrets.redact(); every document stays."""
    return secrets.redact(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, by the rule of mixing.take(), with size, source_size, target and taken."""
    return mixing.take(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        drop_materialised(before)
    return STAGES[-1][1](spark, docs, sf_dir)
