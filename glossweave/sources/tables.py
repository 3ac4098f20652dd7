"""Tables of counts, scores and training rows, to and from text."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.sources.corpus import lines

WORD_FREQUENCY = "word string, frequency long, collection string, document string, idf double, doc_len long"
RELEVANCE = "corpus string, query string, terms long, scoped boolean, rank long, title string, sim_title long, sim_words float, sim_bigrams float, bit_vector float, exact_match long, contains_terms string, relevant long"
SIMILARITY = ["query", "rank", "term", "pinyin_match", "in_notes", "unigram_count", "hamming", "is_substring", "is_relevant"]


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    return lines(spark, path).select(F.split("line", "\t").alias("f")).where(F.size("f") >= least)


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(key, n) of key<TAB>count lines; shorter lines are left out, and counts must be numbers."""
    return _fields(spark, path, 2).select(F.col("f")[0].alias("key"), F.col("f")[1].cast("long").alias("n"))


def total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n").alias("total"))


def mutual_information(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2).select(F.col("f")[0].alias("term"), F.col("f")[1].cast("double").alias("mi"))


def tokenizer_training(spark: SparkSession, path: str) -> DataFrame:
    """(term, mi, has_function_word, result), without the header and short lines."""
    f = _fields(spark, path, 4).where("not startswith(f[0], '#')").select("f")
    return f.select(F.col("f")[0].alias("term"), F.col("f")[1].cast("double").alias("mi"), F.col("f")[2].cast("int").alias("has_function_word"), F.col("f")[3].cast("int").alias("result"))


def similarity_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples by position, as files name the last column differently; a file without it has nulls there."""
    schema = ", ".join(f"{c} {'string' if c in ('query', 'term') else 'int'}" for c in SIMILARITY)
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(WORD_FREQUENCY).csv(path)


def relevance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(RELEVANCE).csv(path)


def write_lines(df: DataFrame, path: str, *columns: str | Column) -> None:
    """Columns joined by tabs, in as many files as there are partitions, with no quotes."""
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in columns))).write.text(path)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the catalog, replacing one of that name."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def dropped(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one while the master is local and it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or f"file://{tempfile.gettempdir()}/glossweave"
