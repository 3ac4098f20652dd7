"""Pairs of characters that stand together more often than by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.scores import pmi


def mutual_information(characters: DataFrame, bigrams: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, mi) of the two-character terms that occur as a pair, in either order.

    characters (character, n), bigrams (bigram, n), terms (term).  Totals are one-row
    aggregates; terms meet the counts in four left joins.
    """
    chars, pairs = characters.select("character", "n"), bigrams.select("bigram", "n")
    t = terms.select("term").where(F.length("term") == 2).distinct()
    t = t.withColumns({"a": F.substring("term", 1, 1), "b": F.substring("term", 2, 1), "back": F.reverse("term")})
    t = t.join(chars.toDF("a", "fa"), "a", "left").join(chars.toDF("b", "fb"), "b", "left")
    t = t.join(pairs.toDF("term", "fab"), "term", "left").join(pairs.toDF("back", "fba"), "back", "left")
    both = F.coalesce("fab", F.lit(0)) + F.when(F.col("term") != F.col("back"), F.coalesce("fba", F.lit(0))).otherwise(0)
    t = t.crossJoin(F.broadcast(chars.agg(F.sum("n").alias("all_chars")))).crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("all_pairs"))))
    zero = F.lit(0)
    score = pmi(both.cast("double"), F.col("all_pairs"), F.coalesce("fa", zero).cast("double"), F.coalesce("fb", zero).cast("double"), F.col("all_chars").cast("double"))
    return t.where(both > 0).select("term", score.alias("mi"))
