"""Dictionary files in the native and the CC-CEDICT format."""

from __future__ import annotations

import os
import urllib.request
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import strip
from glossweave.sources.corpus import lines

COLUMNS = ["id", "simplified", "traditional", "pinyin", "english", "grammar", "concept_cn", "concept_en", "domain_cn", "domain_en", "subdomain_cn", "subdomain_en", "image", "mp3", "notes", "headword"]
#: What stands for nothing in a field.
NOTHING = "\\N"


class ConfigException(Exception):
    """There is no usable configuration."""


def _numbered(spark: SparkSession, where: str) -> DataFrame:
    """(n, line) of a file, or of a web address, which the driver reads: a dictionary is small."""
    if where.startswith(("https://", "http://")):
        with urllib.request.urlopen(where) as response:  # noqa: S310
            text = response.read().decode("utf-8")
        return spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string")
    return lines(spark, where).select(F.monotonically_increasing_id().alias("n"), "line")


def dictionary_lines(spark: SparkSession, places: list[str]) -> DataFrame:
    """COLUMNS, file and ord, the place in the order of files and lines; rows of fewer than ten fields are left out.

    Lines are numbered with an id that grows within and between files, since each file
    is read by itself; fields that a row lacks are null.
    """
    rows = reduce(DataFrame.unionByName, (_numbered(spark, p).select((F.lit(i).cast("long") * (1 << 56) + F.col("n")).alias("ord"), strip(F.col("line")).alias("line")) for i, p in enumerate(places)))
    rows = rows.where("line <> '' and not startswith(line, '#')").select("ord", F.split("line", "\t").alias("f")).where(F.size("f") >= 10)

    def field(i: int, name: str) -> Column:
        value = F.get("f", F.lit(i))
        return (F.try_to_number(value, F.lit("9999999999")).cast("long") if name in ("id", "headword") else value).alias(name)

    return rows.select("ord", (F.col("ord") / (1 << 56)).cast("int").alias("file"), *(field(i, c) for i, c in enumerate(COLUMNS)))


def configured_paths(home: str | None = None) -> list[str]:
    """Files that config.yaml in a folder lists after LUFiles; by default the folder that CNREADER_HOME names, for set-ups that have it."""
    home = home or os.environ.get("CNREADER_HOME")
    if not home:
        raise ConfigException("no folder is given, and CNREADER_HOME is not set")
    with open(f"{home}/config.yaml", encoding="utf-8") as f:
        for line in f:
            if "LUFiles" in line and ":" in line:
                return [f"{home}/data/{x.strip()}" for x in line.split(":", 1)[1].split(",") if x.strip()]
    raise ConfigException("config.yaml has no LUFiles")


def open_lines(spark: SparkSession, where: str | list[str] | None = None) -> DataFrame:
    """dictionary_lines of a web address, a path, several of them, or what is configured."""
    if where is None:
        where = configured_paths()
    return dictionary_lines(spark, [where] if isinstance(where, str) else where)


def cedict_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that do not parse).

    Rows: ord, traditional, simplified, pinyin, english.  The first three are split as
    late as they can be, as greedy patterns do.
    """
    return parsed_cedict(lines(spark, path).select((F.monotonically_increasing_id() + 1).alias("ord"), "line"))


def parsed_cedict(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cedict_rows of lines (ord, line)."""
    pattern = r"(.*) (.*) \[(.*)\] /(.*)/"
    rows = numbered.select("ord", strip(F.col("line")).alias("line"))
    rows = rows.where("line <> '' and not startswith(line, '#')")
    names = ["traditional", "simplified", "pinyin", "english"]
    parsed = rows.where(F.col("line").rlike(pattern)).select("ord", *(F.regexp_extract("line", pattern, i + 1).alias(c) for i, c in enumerate(names)))
    return parsed, rows.where(~F.col("line").rlike(pattern)).select("ord", "line")
