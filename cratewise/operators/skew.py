"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.session import Stored, materialize

# A key is hot from this many rows and one thousandth of all rows on: never more than a thousand hot keys.
HOT_ROWS = 200_000
HOT_SHARE = 1000


def hot_keys(rows: Stored, key: str, min_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of a stored table, at most ``HOT_SHARE`` rows; None when there are none."""
    if rows.rows <= min_rows:
        return None
    bound = max(min_rows, rows.rows / HOT_SHARE)
    counts = rows.df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = materialize(counts.where(F.col("n") > bound).select(key), "hot")
    return found.df if found.rows else None


def even_join(rows: DataFrame, lookup: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``join_lookup`` for rows that are not stored yet: stores them, so that their hot keys are known."""
    stored = materialize(rows, "rows")
    return join_lookup(stored.df, lookup, key, hot_keys(stored, key, min_rows))


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join with a lookup that has one row per key.

    Rows of hot keys meet their at most ``HOT_SHARE`` lookup rows by broadcast and never
    shuffle; the rest joins as Spark sees fit.
    """
    if hot is None:
        return rows.join(lookup, key)
    keys = F.broadcast(hot)
    warm = rows.join(keys, key, "left_semi").join(F.broadcast(lookup.join(keys, key, "left_semi")), key)
    return warm.unionByName(rows.join(keys, key, "left_anti").join(lookup, key))
