"""Pinyin with marks to pinyin with numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, their plain letters, and their tones, place by place.
MARKED = "āáǎàēéěèīíǐìōóǒòūúǔù"
PLAIN = "aaaaeeeeiiiioooouuuu"
TONES = "12341234123412341234"


def numbered(syllable: Column, last_letter_only: bool = False) -> Column:
    """fēn to fen1.

    last_letter_only: only a mark on the last letter gives a number, so fēn becomes fen,
    for results that must equal those of older tools.
    """
    marked = F.regexp_replace(syllable, f"[^{MARKED}]", "")
    letter = F.substring(syllable, -1, 1) if last_letter_only else F.substring(marked, -1, 1)
    tone = F.when(letter.rlike(f"^[{MARKED}]$"), F.translate(letter, MARKED, TONES)).otherwise("")
    return F.concat(F.translate(syllable, MARKED, PLAIN), tone)
