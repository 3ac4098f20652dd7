"""How far apart two short strings are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(n: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(n, F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, plus what a has beyond b; what b has beyond a is free."""
    common = F.least(F.length(a), F.length(b))
    differ = F.filter(_places(common), lambda i: (i <= common) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.size(differ) + F.greatest(F.length(a) - F.length(b), F.lit(0))


def shared_characters(a: Column, b: Column) -> Column:
    """Characters of a, repeats included, that b has."""
    return F.size(F.filter(F.split(a, ""), lambda c: (c != "") & (F.instr(b, c) > 0)))
