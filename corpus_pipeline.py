"""A training corpus from documents: language, quality, exact copies, near copies, packing.

Every stage takes and returns whole rows of documents, except the last, which returns the pieces of packed windows.

Defined cases, for every stage: columns other than doc_id and text, whatever their names, are carried unread (language also learns from
lang); null ids and ids that repeat are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import dedup, langid, packing, quality, simhash
from quire.llm.queries import WORD_VOCABULARY
from quire.llm.workspace import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learned language, go; so do null texts, and all texts if no row has a lang."""
    return langid.accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go, null and empty texts among them; very long texts are measured whole."""
    return quality.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest original with the smallest id stays; null is equal to empty."""
    return dedup.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; null, empty and blank texts are one class."""
    return simhash.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows that hold every token of every remaining document; null and empty texts are their end token."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing_stage),
]
#: Language models, fingerprints and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
