"""Lines, characters and annotated tokens.  Text is counted in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PUNCTUATION = "，；。、()"
FUNCTION_WORDS = "有不無下上為後"
_SPACE = r"[\s\x1c-\x1f]"


def strip(line: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(line, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def without_ascii(line: Column) -> Column:
    """Characters above U+0080; U+0080 itself goes too."""
    return F.regexp_replace(line, r"[\x00-\x{80}]", "")


def characters(line: Column) -> Column:
    """The characters above U+0080, one element each."""
    return F.array_remove(F.split(without_ascii(line), ""), "")


def bigrams(line: Column) -> Column:
    """Neighbours among the characters above U+0080, whatever ASCII stands between them.

    The array of characters meets its own tail, in time linear in the line; the array
    around it binds it, so it is made once.
    """
    return F.transform(F.array(characters(line)), lambda c: F.array_compact(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y))))[0]


def kept_line(line: Column, patterns: list[str]) -> Column:
    """True unless a pattern occurs, in any case; patterns are regular expressions and empty ones are skipped.

    A pattern is tied to the start of the line behind any text, as ``.*pattern.*`` is.
    """
    found = [line.rlike(f"(?iud)^(?:.*{p}.*)") for p in patterns if p.strip()]
    return reduce(lambda a, b: a & ~b, found, F.lit(True))


def annotation_line(line: Column, strict: bool = True) -> Column:
    """Lines of tokens in an annotated text.

    strict: the lines that begin with none of the letters of the markers, which is how
    the markers were once tested; otherwise those that begin with no whole marker.
    """
    marker = "^[#|NoteSurcTanslirE]" if strict else "^(#|Note|Source|Translation|Error)"
    return (line != "") & ~line.rlike(marker)


def annotated_tokens(line: Column) -> Column:
    return F.filter(F.split(line, "、"), lambda t: strip(t) != "")


def without_punctuation(term: Column) -> Column:
    return F.translate(term, PUNCTUATION, "")


def has_function_word(term: Column) -> Column:
    return term.rlike(f"[{FUNCTION_WORDS}]").cast("int")


def error_term(line: Column) -> Column:
    """The term of an error line, null if there is none."""
    found = F.regexp_extract(line, r"^Error: (.*) \(", 1)
    return F.when(line.rlike(r"^Error: .* \("), found)


def any_of(target: Column, keywords: list[str]) -> Column:
    """Does any keyword occur?  Case counts."""
    return reduce(lambda a, b: a | b, (F.contains(target, F.lit(k)) for k in keywords))


def has_latin_or_digit(text: Column) -> Column:
    return text.rlike("[a-zA-Z0-9]")


def has_listing_mark(text: Column) -> Column:
    return any_of(text, ["、", "，"])


def is_reference(english: Column) -> Column:
    """Begins like a reference to a variant."""
    return english.startswith("variant") | english.startswith("see")


def is_long(english: Column) -> Column:
    return F.length(english) > 70
