"""Words like a given one: one scan of the dictionary, never a join of it with itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.distance import hamming, shared_characters
from glossweave.operators import dictionary

#: Shorter keys never set the best value.
MIN_LENGTH = 2


def _best(keys: DataFrame, score: Column, order_dependent: bool, start: int) -> DataFrame:
    """Keys whose score is smallest, ties included.

    order_dependent: the ties of short keys count only behind the first long key that
    reaches the best value, and start is the value to beat, for results that must equal
    those of a walk in dictionary order.
    """
    scored = keys.withColumn("score", score)
    long = scored.where(F.length("key") >= MIN_LENGTH)
    if not order_dependent:
        best = long.agg(F.min("score").alias("m"))
        return long.crossJoin(F.broadcast(best)).where("score = m").select("key", "score")
    best = long.groupBy("score").agg(F.min("ord").alias("first")).agg(F.min(F.struct("score", "first")).alias("b"))
    m = F.least(F.coalesce("b.score", F.lit(start)), F.lit(start))
    met = scored.crossJoin(F.broadcast(best)).withColumn("m", m).where("score = m")
    behind = (F.length("key") >= MIN_LENGTH) | (F.col("m") == start) | (F.col("ord") > F.col("b.first"))
    return met.where(behind).select("key", "score")


def by_hamming(entries: DataFrame, word: str, order_dependent: bool = False) -> DataFrame:
    """(key, score) with the fewest differing places."""
    keys = entries.where(F.col("key") != word)
    return _best(keys, hamming(F.lit(word), F.col("key")), order_dependent, 100)


def by_characters(entries: DataFrame, word: str, order_dependent: bool = False) -> DataFrame:
    """(key, score) with the most characters of the word."""
    keys = entries.where(F.col("key") != word)
    found = _best(keys, -shared_characters(F.lit(word), F.col("key")), order_dependent, 0)
    return found.withColumn("score", -F.col("score"))


def by_pinyin(entries: DataFrame, word: str, order_dependent: bool = False) -> DataFrame:
    """(key, score) whose pinyin differs least from that of the word; a word that isn't there is like nothing."""
    e = dictionary.rolled_up(entries)
    own = e.where(F.col("key") == word).select(F.col("pinyin").alias("own_pinyin"), F.col("simplified").alias("own_simplified"))
    rest = e.where(F.col("key") != word).crossJoin(F.broadcast(own)).where("simplified <> own_simplified")
    return _best(rest, hamming(F.col("own_pinyin"), F.col("pinyin")), order_dependent, 100)


def similar(entries: DataFrame, word: str, order_dependent: bool = False) -> DataFrame:
    """The keys that any of the three measures finds."""
    found = [f(entries, word, order_dependent).select("key") for f in (by_pinyin, by_hamming, by_characters)]
    return reduce(DataFrame.unionByName, found).distinct()
