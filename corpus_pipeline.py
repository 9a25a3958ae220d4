"""Corpus pipeline over `documents`: each stage is one operator of tidewater.llm.

The quality classifier's rejects go, one document of each group of near duplicates stays, documents that hold a
benchmark item go, secrets are masked in the texts, and the rest is mixed to target weights. Every stage takes tables
with nulls in any column, empty and long texts, repeated rows and further columns; on an empty table it gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontamination, mixing, quality, secrets, simhash_dedup
from tidewater.llm.base import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality scores 0.3 or more, by a classifier that `labels` trains on these documents.

    Null and empty texts are scored as empty ones; repeated rows stay or go together; without labels all stay.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: that of the smallest id, a null id only if there is no other.

    Repeated rows are one group, and so are all null, empty and blank texts.
    """
    return simhash_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item of `benchmark` is found; null and empty texts hold none, items without words match none."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and access identifiers masked in their texts; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: all documents with how often and from which slot on each is read, and what is taken of it.

    Documents without words are taken never; repeated rows are documents of their own; a null source comes last.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The stages train a model and link fingerprints; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus from `documents`: the stages in turn, each on what the one before has written.

    Rows that no stage has removed, whatever their nulls, with the columns of documents and those of the mix; none from
    an empty table.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
