"""Entries of a bilingual dictionary, look-up, and conversion between scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.sources.dictionaries import NOTHING


def entries(lines: DataFrame, merge: str = "append", chinese_only: bool = False, repeat_same: bool = False) -> DataFrame:
    """(key, ord, headword, headword_id, senses) from dictionary_lines.

    A line gives a sense to its simplified key and, if it has one, its traditional key.
    merge: "append" puts the senses of all files together, "replace" keeps those of the
    last file that has the key.  chinese_only leaves pinyin and the rest null.
    repeat_same: a line whose two forms are equal gives its sense twice.
    """
    shown = ["simplified", "traditional", "pinyin", "english", "grammar", "notes"]
    sense = F.struct("ord", *(F.col(c) if not chinese_only or c in shown[:2] else F.lit(None).cast("string").alias(c) for c in shown))
    keys = F.array("simplified", F.when(F.col("traditional") != NOTHING, F.col("traditional")))
    keys = F.filter(keys if repeat_same else F.array_distinct(keys), lambda k: k.isNotNull())
    rows = lines.select("ord", "file", "headword", sense.alias("sense"), F.explode(keys).alias("key"))
    if merge == "replace":
        last = rows.groupBy("key").agg(F.max("file").alias("file"))
        rows = rows.join(last, ["key", "file"], "left_semi")
    grouped = rows.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("headword", "ord").alias("headword_id"), F.sort_array(F.collect_list("sense")).alias("senses"))
    return grouped.select("key", "ord", F.col("key").alias("headword"), "headword_id", F.transform("senses", lambda s: s.dropFields("ord")).alias("senses"))


def english(senses: Column) -> Column:
    """One sense as it is, several numbered."""
    numbered = F.transform(senses, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["english"]))
    return F.when(F.size(senses) == 1, senses[0]["english"]).otherwise(F.array_join(numbered, "; "))


def pinyin(senses: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(senses, lambda s: s["pinyin"]))), ", ")


def simplified(senses: Column) -> Column:
    """Distinct forms in the order of the senses."""
    return F.array_join(F.array_distinct(F.transform(senses, lambda s: s["simplified"])), "、")


def traditional(senses: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(senses, lambda s: s["traditional"])), "、")


def rolled_up(entry: DataFrame) -> DataFrame:
    s = F.col("senses")
    return entry.withColumns({"english": english(s), "pinyin": pinyin(s), "simplified": simplified(s), "traditional": traditional(s)})


def lookup(entry: DataFrame, keyword: str) -> DataFrame:
    """The entry of a key, or nothing."""
    return entry.where(F.col("key") == keyword)


def characters_known(entry: DataFrame, value: Column) -> dict[str, object]:
    """character: value, of the keys of one character.  There are no more of them than Unicode has code points."""
    rows = entry.where(F.length("key") == 1).select("key", value.alias("v")).collect()
    return {r.key: r.v for r in rows}


def _converted(df: DataFrame, text: str, known: dict, convert, kind: str) -> Column:
    """A column of convert(text, known), over Arrow batches; nothing is shuffled."""
    held = df.sparkSession.sparkContext.broadcast(known)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else convert(t, held.value))

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(F.col(text))


def to_traditional(df: DataFrame, entry: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``converted``: first senses' traditional forms, the simplified where there is none, unknown characters as they are."""
    first = F.col("senses")[0]
    value = F.when(first["traditional"] == NOTHING, first["simplified"]).otherwise(first["traditional"])
    known = {c: v for c, v in characters_known(entry, value).items() if v is not None}
    return df.withColumn("converted", _converted(df, text, known, lambda t, k: "".join(k.get(c, c) for c in t), "string"))


def _sounds(text: str, known: dict) -> list[str]:
    """Simplified form and pinyin."""
    found = [known.get(c, (c, " ")) for c in text]
    return ["".join(c if s is None else s for c, (s, _) in zip(text, found, strict=True)), (" " if len(found) > 3 else "").join(p or "" for _, p in found).lower()]


def to_simplified(df: DataFrame, entry: DataFrame, text: str = "text") -> DataFrame:
    """Adds simplified, traditional ("\\N" if nothing changed) and pinyin, lower case, apart if there are more than three."""
    first = F.col("senses")[0]
    known = {c: tuple(v) for c, v in characters_known(entry, F.struct(first["simplified"], first["pinyin"])).items()}
    (both,) = unused(df, "both")
    out = df.withColumn(both, _converted(df, text, known, _sounds, "array<string>"))
    one = F.col(both)[0]
    return out.withColumns({"simplified": one, "traditional": F.when(one == F.col(text), NOTHING).otherwise(F.col(text)), "pinyin": F.coalesce(F.col(both)[1], F.lit(""))}).drop(both)


def assembled(parts: DataFrame, entry_lines: DataFrame, english: str, grammar: str, references: str = "") -> DataFrame:
    """A new entry from the parts (ord, part) of a word: each by its traditional form, else its simplified one.

    Of several lines the first counts.  ``found`` says whether all parts were found; the
    id is the number of lines and two.
    """
    def first_of(column: str, name: str) -> DataFrame:
        value = F.struct("simplified", F.when(F.lit(column == "traditional"), F.col("traditional")).otherwise(F.col("simplified")).alias("traditional"), "pinyin")
        return entry_lines.groupBy(F.col(column).alias("part")).agg(F.min_by(value, "ord").alias(name))

    met = parts.join(first_of("traditional", "t"), "part", "left").join(first_of("simplified", "s"), "part", "left")
    met = met.withColumn("v", F.coalesce("t", "s"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "v")))
    joined = lambda f: F.array_join(F.transform("vs", lambda x: F.coalesce(x["v"][f], F.lit(""))), "")
    row = met.groupBy().agg(ordered.alias("vs"), F.bool_and(F.col("v").isNotNull()).alias("found"))
    row = row.select(joined("simplified").alias("simplified"), joined("traditional").alias("trad"), F.replace(joined("pinyin"), F.lit(" "), F.lit("")).alias("pinyin"), "found")
    size = entry_lines.agg((F.count("id") + 2).alias("id"))
    notes = F.lit(f"({references})" if references else "")
    return row.crossJoin(size).select("id", "simplified", F.when(F.col("simplified") == F.col("trad"), NOTHING).otherwise(F.col("trad")).alias("traditional"), "pinyin", F.lit(english).alias("english"), F.lit(grammar).alias("grammar"), notes.alias("notes"), "found")
