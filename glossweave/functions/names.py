"""Names of temporary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of df's columns (or a list of them), whatever their case."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out
