"""How often characters, pairs of characters and terms occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glossweave.functions.text import bigrams, characters, kept_line, strip


def without_boilerplate(lines: DataFrame, patterns: list[str]) -> DataFrame:
    return lines.where(kept_line(F.col("line"), patterns)) if patterns else lines


def counted(lines: DataFrame, items: Column, name: str) -> DataFrame:
    """(name, n) of an array of items per line; Spark adds up each task's counts before it shuffles them."""
    return lines.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def character_counts(lines: DataFrame, patterns: list[str] = ()) -> DataFrame:
    return counted(without_boilerplate(lines, list(patterns)), characters(strip(F.col("line"))), "character")


def bigram_counts(lines: DataFrame, patterns: list[str] = ()) -> DataFrame:
    return counted(without_boilerplate(lines, list(patterns)), bigrams(strip(F.col("line"))), "bigram")


def term_counts(tokenized: DataFrame) -> DataFrame:
    """Counts of the elements of ``tokens``, ASCII and spaces among them."""
    return counted(tokenized, F.col("tokens"), "term")


def observed(counts: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """counts, and an Observation of how many items and distinct items there were, known after an action.

    Unlike accumulators, observations don't count retried tasks twice.
    A session that has observed can't train Spark's models after that (in 4.1 its state is no
    longer serializable): where both are needed, read ``counts`` in a ``newSession()``.
    """
    seen = Observation(name)
    return counts.observe(seen, F.sum("n").alias("items"), F.count("*").alias("distinct_items")), seen
