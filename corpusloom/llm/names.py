"""Column names of the operators' own beside a caller's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare_names(df: DataFrame, *wished: str) -> list[str]:
    """A name for each wish that no column of `df` has, in any case of letters."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in wished:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
