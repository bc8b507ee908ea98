"""Running totals, consecutive numbers and list pages over whole tables, without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.session import materialize

PAGE_SIZE = 100_000


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``totals`` in the global order of ``order`` (a unique key).

    Rows are range-partitioned once and stored with their partition number, so both uses
    see the same split. Each partition sums its own rows; the offsets between partitions
    are one row per partition, which bounds both their window and their broadcast.
    """
    names = list(totals)
    ranged = df.withColumns({f"_add_{n}": c for n, c in totals.items()}).repartitionByRange(*order)
    stored = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged").df
    per_part = stored.groupBy("_part").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in names])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return stored.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.sum(f"_add_{n}").over(inside) + F.col(f"_off_{n}")).alias(n) for n in names]
    )


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the global order of ``order``."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")})


def list_pages(pairs: DataFrame, key: str, item: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """``(key, page, pages, items)``: the sorted items of each key in pages of about ``page_size``.

    ``pairs`` must be distinct. A key with at most ``page_size`` items has the single page 0;
    a longer list is split by a hash of the item, so no task gathers a hub's whole list.
    """
    large = (
        pairs.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > page_size)
        .select(key, F.ceil(F.col("n") / page_size).alias("pages"))
    )
    paged = pairs.join(large, key, "left").withColumn("pages", F.coalesce("pages", F.lit(1)).cast("bigint"))
    return (
        paged.withColumn("page", F.pmod(F.crc32(item), "pages"))
        .groupBy(key, "page", "pages")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )


def whole_lists(pages: DataFrame, key: str, name: str) -> DataFrame:
    """The whole sorted list of every key, put together from its pages; one row holds a list."""
    return pages.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("items"))).alias(name))


def single_lists(pages: DataFrame, key: str, name: str) -> DataFrame:
    """The lists that fit one page, one row per key; longer ones stay in their pages."""
    return pages.where(F.col("pages") == 1).select(key, F.col("items").alias(name))
