"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the mix by weight, at most twice its size; the excess goes to the
other sources by weight. Every document of a source is expected ``target / size`` times: in a fixed
order, the expected copies are summed up, one random offset is added, and a document is emitted once
for each integer boundary that its share crosses. The order is by size, largest first, so neighbours
in the sum are alike. The offset is drawn among ``OFFSETS`` evenly spaced ones with a random start:
the one whose words come nearest to the target.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its
own and comes last; repeated rows are taken separately; an empty table or one without words gives
targets of 0; other columns are ignored by ``mix_sizes`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.columns import spare
from cratewise.operators.sequence import number_rows, running_totals
from cratewise.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
OFFSETS = 32
#: Sources up to this many are broadcast (about 100 bytes each); beyond it the join is shuffled and salted.
BROADCAST_SOURCES = 100_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``sources`` (``source``, ``source_size``, ``docs``) with ``target`` and ``before``: the documents of earlier sources.

    In the order of size by weight, the sources that reach their limit come first; the level of the
    rest is what remains of the mix by the weight that remains.
    """
    named = sources.withColumn("unnamed", F.col("source").isNull())
    counted = running_totals(named, ["unnamed", "source"], {"number": F.lit(1).cast("bigint"), "through": F.col("docs")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = counted.select("source", "source_size", "docs", "number", (F.col("through") - F.col("docs")).alias("before"), weight.alias("weight"))
    weighed = weighed.withColumn("fullness", F.col("source_size") / F.col("weight"))
    summed = materialize(running_totals(weighed, ["fullness", "number"], {"sizes": F.col("source_size"), "weights": F.col("weight").cast("bigint")}), "targets").df
    total = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (share * total["size"] - limit * (F.col("sizes") - F.col("source_size"))) / (total["weight"] - F.col("weights") + F.col("weight"))
    best = summed.select(F.max(F.when(level * F.col("weight") <= limit * F.col("source_size"), level)).alias("level")).first()["level"]
    target = F.least(F.lit(limit).cast("double") * F.col("source_size"), F.lit(best or 0.0) * F.col("weight"))
    return summed.select("source", "source_size", "docs", "before", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    same = rows["source"].eqNullSafe(sources["source"])
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), same).drop(sources["source"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = rows["source"].eqNullSafe(copies["source"]) & (rows["salt"] == copies["salt"])
    return rows.join(copies, same).drop(copies["source"]).drop(rows["salt"]).drop(copies["salt"])


def _copies(rank: Column, rate: Column, offset: Column) -> Column:
    through = lambda r: F.floor(r * rate + offset)
    return F.least(through(rank) - through(rank - 1), F.ceil(rate)).cast("bigint")


def mix_sizes(docs: DataFrame, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` per row of ``docs`` (``doc_id``, ``source``, ``text``).

    ``keep`` names further columns of ``docs`` to carry along.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *keep), "sizes").df
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    stored = materialize(targets(by_source), "sources")
    order = sized.select(
        "*", F.col("source").isNull().alias("unnamed"), (-F.col("size")).alias("falling"), F.xxhash64(F.lit(seed), "doc_id").alias("tie")
    )
    placed = materialize(number_rows(order, ["unnamed", "source", "falling", "tie", "doc_id"], "place").drop("unnamed", "falling", "tie"), "placed").df
    known = _with_source(placed, stored.df, stored.rows)
    rank, rate = F.col("place") - F.col("before"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # binary fractions: sums with a whole rate stay exact
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 15)) / float(1 << 20)
    at = [start + F.lit(k / OFFSETS) for k in range(OFFSETS)]
    words = known.groupBy("source").agg(F.first("target").alias("t"), *[F.sum(_copies(rank, rate, u) * F.col("size")).alias(f"w{k}") for k, u in enumerate(at)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("miss"), F.lit(k).alias("k")) for k in range(OFFSETS)]))["k"]
    drawn = words.select("source", (start + nearest / F.lit(float(OFFSETS))).alias("offset"))
    final = stored.df.alias("s").join(drawn.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source"))).select("s.*", "offset")
    known = _with_source(placed, final, stored.rows)
    copies = _copies(rank, rate, F.col("offset"))
    return known.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *keep)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns."""
    columns = docs.columns
    uid, total, rows, nth, copy = spare(docs, "_uid", "_all", "_rows", "_nth", "_copy")
    parts = [x for c in ("doc_id", "source", "text") for x in (F.col(c), F.isnull(c))]  # nulls leave no trace in a hash
    marked = docs.withColumn(uid, F.xxhash64(*parts))
    # equal rows stand for one another: their copies are summed and dealt out again
    taken = mix_sizes(marked, seed, (uid,)).groupBy(uid).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    taken = taken.where(F.col(total) > 0)
    numbered = marked.join(taken, uid).withColumn(nth, F.row_number().over(Window.partitionBy(uid).orderBy(uid)))
    times = F.floor(F.col(total) / F.col(rows)) + F.when(F.col(nth) <= F.col(total) % F.col(rows), 1).otherwise(0)
    return numbered.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*columns)
