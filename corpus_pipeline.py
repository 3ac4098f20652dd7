"""Cleaning and packing of documents: stages that each take what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import decontam, linededup, neardup, packing, quality
from glossweave.llm.common import table, tokenizer, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of the rules reject go, those with null or empty texts among them.

    All columns stay, whatever their names; repeated rows are judged alike.
    """
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest doc_id only; a null doc_id is the smallest.

    Rows that share a doc_id keep or lose a line together.  All columns stay, whatever their names.
    """
    return linededup.deduped(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words to a shingle, a similarity of 0.8 or more.

    Rows with null or shared doc_ids are judged each by its text; of a row that is repeated one stays.
    """
    return neardup.deduped(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; null and empty texts hold none, and repeated rows are judged alike."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences; a null doc_id stays null, an empty text is its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Estimated probabilities and trained vocabularies are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
