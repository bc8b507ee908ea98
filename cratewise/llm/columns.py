"""Names for helper columns beside whatever columns a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores added until no column of ``df`` has the name, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
