"""Similarity samples out of application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema("textPayload string").json(paths)


def samples(logs: DataFrame, relevant_at: int = 8) -> DataFrame:
    """One row for each payload whose part after the last colon has nine values or more.

    rank counts from one; rows with a value that is no number go.  relevant_at: the
    value that says whether a sample is relevant; 7 repeats is_substring.
    """
    v = F.split(F.element_at(F.split("textPayload", ":"), -1), ",")
    rows = logs.where(F.contains("textPayload", F.lit(":"))).select(v.alias("v")).where(F.size("v") > 8)
    number = lambda i: F.expr(f"try_cast(trim(v[{i}]) as int)")
    out = rows.select(
        F.trim(F.col("v")[0]).alias("query"), (number(1) + 1).alias("rank"), F.trim(F.col("v")[2]).alias("term"),
        number(3).alias("pinyin_match"), number(4).alias("in_notes"), number(5).alias("unigram_count"),
        number(6).alias("hamming"), number(7).alias("is_substring"), number(relevant_at).alias("is_relevant"),
    )
    return out.dropna(subset=[c for c in out.columns if c not in ("query", "term")])
