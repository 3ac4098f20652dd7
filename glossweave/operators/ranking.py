"""Word frequencies by document, and documents ranked by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.scores import BM25_AVERAGE_LENGTH, bm25


def word_frequencies(tokens: DataFrame) -> DataFrame:
    """(word, frequency, collection, document, idf, doc_len) from (collection, document, word).

    idf is log10((documents + 1) / documents with the word).  Words are counted within
    documents first, and all else follows from those counts.
    """
    tf = tokens.groupBy("collection", "document", "word").agg(F.count("*").alias("frequency"))
    length = tf.groupBy("collection", "document").agg(F.sum("frequency").alias("doc_len"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = length.agg(F.count("*").alias("documents"))
    out = tf.join(length, ["collection", "document"]).join(df, "word").crossJoin(F.broadcast(n))
    idf = F.log10((F.col("documents") + 1) / F.col("df"))
    return out.select("word", "frequency", "collection", "document", idf.alias("idf"), "doc_len")


def ranked(frequencies: DataFrame, words: list[str], limit: int = 5000, average: float = BM25_AVERAGE_LENGTH) -> DataFrame:
    """(document, bm25) of the documents with any of the words, best first, ties by document."""
    score = bm25(F.col("frequency"), F.col("idf"), F.col("doc_len"), average=average)
    scored = frequencies.where(F.col("word").isin(words)).groupBy("document").agg(F.sum(score).alias("bm25"))
    return scored.orderBy(F.desc("bm25"), "document").limit(limit)


def of_word(frequencies: DataFrame, word: str, limit: int = 2000) -> DataFrame:
    """A word's rows, most frequent first, ties by document."""
    return frequencies.where(F.col("word") == word).orderBy(F.desc("frequency"), "document").limit(limit)
