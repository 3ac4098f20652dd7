"""From lines to mutual information, training rows and a filter for tokens: one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import strip
from glossweave.operators import colloc, counts, evaluate, tokenize


@dataclass
class Chain:
    characters: DataFrame
    bigrams: DataFrame
    terms: DataFrame
    information: DataFrame


def chain(lines: DataFrame, words: DataFrame, patterns: list[str] = ()) -> Chain:
    """Counts of characters, pairs and terms of (line), and the mutual information of two-character terms.

    The lines are read once for each count, or once in all if the caller persists them.
    """
    kept = counts.without_boilerplate(lines, list(patterns)).select(strip(F.col("line")).alias("line"))
    characters, bigrams = counts.character_counts(kept), counts.bigram_counts(kept)
    terms = counts.term_counts(tokenize.tokenize(kept, words, "line"))
    return Chain(characters, bigrams, terms, colloc.mutual_information(characters, bigrams, terms.select("term")))


def training(annotated: DataFrame, information: DataFrame) -> DataFrame:
    """Training rows of a tokenizer filter from an annotated text (ord, line)."""
    rows, _ = evaluate.training_rows(evaluate.labelled_terms(annotated), information)
    return rows.orderBy("ord").drop("ord")
