"""Corpus files, one by one or by the indexes that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECTION_COLUMNS = ["collection_file", "html_gloss_file", "title", "description", "introduction_file", "corpus", "language", "format", "period"]
DOCUMENT_COLUMNS = ["source_file", "gloss_file", "title"]


def lines(spark: SparkSession, paths: str | list[str], with_file: bool = False) -> DataFrame:
    """(line), or (file, line): lines end at line feeds, and a carriage return before one goes."""
    df = spark.read.text(paths, lineSep="\n")
    line = F.regexp_replace("value", "\r$", "").alias("line")
    return df.select(F.col("_metadata.file_path").alias("file"), line) if with_file else df.select(line)


def joined_path(name: Column, folder: str = "") -> Column:
    return F.concat_ws("/", F.lit(folder), name) if folder else name


def index(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """A tab-separated index without its comments and blank lines; missing fields are null."""
    return parsed_index(lines(spark, path), columns)


def parsed_index(rows: DataFrame, columns: list[str], cut_comments: bool = False) -> DataFrame:
    """The same of lines (line).  cut_comments: a # ends a line wherever it stands."""
    line = F.regexp_replace("line", "#.*$", "") if cut_comments else F.col("line")
    kept = rows.select(line.alias("line")).where("line <> '' and not startswith(line, '#')")
    return kept.select(*(F.get(F.split("line", "\t"), F.lit(i)).alias(c) for i, c in enumerate(columns)))


def indexed_paths(spark: SparkSession, home: str, prefix: str = "") -> list[str]:
    """Paths of all documents: collections name indexes, which name documents.

    Two small indexes are read on the driver, as paths have to be known to plan a scan.
    """
    data = f"{home}/data/corpus"
    names = [r[0] for r in index(spark, f"{data}/collections.csv", COLLECTION_COLUMNS).select("collection_file").collect()]
    folder = f"{home}/{prefix}" if prefix else home
    if not names:
        return []
    documents = index(spark, [f"{data}/{n}" for n in names], DOCUMENT_COLUMNS)
    return [r[0] for r in documents.select(joined_path(F.col("source_file"), folder)).collect()]


def indexed_lines(spark: SparkSession, home: str, prefix: str = "", with_file: bool = False) -> DataFrame:
    paths = indexed_paths(spark, home, prefix)
    if not paths:
        return spark.createDataFrame([], "file string, line string" if with_file else "line string")
    return lines(spark, paths, with_file)


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Regular expressions of lines to leave out; blank lines are skipped, as they would match everything."""
    return [r.line for r in lines(spark, path).where("trim(line) <> ''").collect()]


#: A line up to the first # that no double quotes enclose.
_UNCOMMENTED = '^([^"#]*+(?:"[^"]*+"[^"#]*+)*+)#.*$'


def typed_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, comment: str | None = None) -> DataFrame:
    """A table of text; without a schema the types are inferred.  comment: lines that begin with it are left out."""
    reader = spark.read.option("header", header).option("sep", sep)
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def typed_lines(rows: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """Typed columns of lines (line) without a header.  A # outside double quotes ends a line wherever it stands.

    Null lines and those of which nothing is left but white space give no rows; missing fields and those of another type are null.
    """
    kept = rows.select(F.regexp_replace("line", _UNCOMMENTED, "$1").alias("line")).where("line rlike '[^\\\\s]'")
    return kept.select(F.from_csv("line", schema, {"sep": sep}).alias("x")).select("x.*")
