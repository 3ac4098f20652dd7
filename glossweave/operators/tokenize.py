"""Greedy longest-match tokens: from each place the longest dictionary word, else one character.

Three ways give the same tokens: a pattern inside Spark's own expressions for short
lists of words, Arrow batches with the dictionary sent to each executor for real
dictionaries, and a join for dictionaries that are too large to send.  ``tokenize``
chooses by the counted size of the dictionary, whatever the texts.  Tokens joined
give the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.names import unused

#: Up to so many words a pattern is faster, and up to so many words of so many characters in all a dictionary is sent to executors.
PATTERN_WORDS, SENT_WORDS, SENT_CHARACTERS = 2_000, 2_000_000, 16_000_000
_NONE = "array<string>"


def tokens_by_pattern(text: Column, words: list[str]) -> Column:
    """Leftmost-first alternation of words, longest first, is greedy longest match."""
    ordered = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    pattern = "|".join([*(re.escape(w) if w.isascii() else r"\Q" + w + r"\E" for w in ordered), "(?s:.)"])
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens_by_join(df: DataFrame, words: DataFrame, text: str = "text", exclude_whole: bool = False) -> DataFrame:
    """Adds ``tokens``: pieces of each text meet the dictionary (word) in a semi-join, then the text is walked once.

    exclude_whole: a text is no word of itself.  Texts are tokenized once each; a piece
    travels with the 128-bit digest of its text, never with the text.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 1
    digest = F.unhex(F.md5("t")).alias("h")
    one = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).select("t", digest).dropDuplicates(["h"])
    heads = F.transform(F.array(F.split("t", "")), lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(c, i, F.lit(longest)), "").alias("head"))))[0]
    at = one.select("h", "t", F.length("t").alias("all")).select("h", "all", F.explode(heads).alias("x")).select("h", "all", "x.i", "x.head")
    pieces = at.select("h", "i", "all", "head", F.explode(F.sequence(F.lit(1), F.greatest(F.length("head"), F.lit(1)))).alias("n"))
    pieces = pieces.select("h", "i", "n", "all", F.expr("substring(head, 1, n)").alias("word")).where("word <> ''")
    if exclude_whole:
        pieces = pieces.where("n < all")
    found = pieces.join(words.select("word").distinct(), "word", "left_semi").groupBy("h", "i").agg(F.max("n").alias("n"))
    longest_at = found.groupBy("h").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n"))

    def walk(texts: pd.Series, places: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([walked(t, {} if i is None else dict(zip(i, n, strict=True))) for t, i, n in zip(texts, places, lengths, strict=True)], dtype=object)

    done = one.join(longest_at, "h", "left").select("h", F.pandas_udf(walk, _NONE, F.PandasUDFType.SCALAR)("t", "i", "n").alias("tokens"))
    h, tokens = unused(df, "h", "tokens")
    done = done.select(F.col("h").alias(h), F.col("tokens").alias(tokens))
    out = df.withColumn(h, F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))).join(done, h)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != "tokens"), F.col(tokens).alias("tokens"))


def walked(text: str, longest: dict[int, int]) -> list[str]:
    """Tokens of a text by the length of the longest word at each place, counted from 1."""
    out, i = [], 0
    while i < len(text):
        n = longest.get(i + 1, 1)
        out.append(text[i : i + n])
        i += n
    return out


def sizes(words: frozenset[str]) -> dict[str, list[int]]:
    """For each first character the lengths of its words, longest first."""
    out: dict[str, set[int]] = {}
    for w in words:
        out.setdefault(w[0], set()).add(len(w))
    return {c: sorted(n, reverse=True) for c, n in out.items()}


def greedy(words: frozenset[str], lengths: dict[str, list[int]], text: str, exclude_whole: bool = False) -> list[str]:
    out, i = [], 0
    while i < len(text):
        for n in lengths.get(text[i], ()):
            if text[i : i + n] in words and i + n <= len(text) and not (exclude_whole and n == len(text)):
                break
        else:
            n = 1
        out.append(text[i : i + n])
        i += n
    return out


def tokens_by_arrow(text: Column, words, exclude_whole: bool = False) -> Column:
    """In Python over Arrow batches; words: what Spark broadcast, or a list of words."""
    held = words if hasattr(words, "value") else None
    given = None if held else _prepared(words)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, lengths = held.value if held else given
        for texts in batches:
            yield texts.map(lambda t: greedy(known, lengths, t or "", exclude_whole))

    return F.pandas_udf(run, _NONE, F.PandasUDFType.SCALAR_ITER)(text)


def _prepared(words) -> tuple[frozenset[str], dict[str, list[int]]]:
    held = frozenset(w for w in words if w)
    return held, sizes(held)


def tokenize(df: DataFrame, words: DataFrame, text: str = "text", exclude_whole: bool = False) -> DataFrame:
    """Adds ``tokens``, in place of a column of that name.  A null text has none."""
    one = words.select("word").where("word <> ''").distinct()
    n, characters = one.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if n > SENT_WORDS or characters > SENT_CHARACTERS:
        return tokens_by_join(df, words, text, exclude_whole)
    known = [r.word for r in one.collect()]
    whole = F.coalesce(F.col(text), F.lit(""))
    if not exclude_whole and n <= PATTERN_WORDS:
        return df.withColumn("tokens", tokens_by_pattern(whole, known))
    return df.withColumn("tokens", tokens_by_arrow(whole, df.sparkSession.sparkContext.broadcast(_prepared(known)), exclude_whole))
