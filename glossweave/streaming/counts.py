"""Counts over a stream of lines; the expressions are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossweave.operators import counts

COUNTS = {"characters": counts.character_counts, "bigrams": counts.bigram_counts}


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files as they come to a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def counted_stream(lines: DataFrame, kind: str, patterns: list[str] = ()) -> DataFrame:
    """Running counts; state grows with distinct items, not with text."""
    return COUNTS[kind](lines, patterns)


def start(counts_so_far: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Complete counts in a table in memory, for as many distinct items as characters make."""
    return counts_so_far.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
