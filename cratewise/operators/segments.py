"""A search index in segments: changes are written beside what is there, and merged by size.

A segment has the postings and documents of one change and ``gone``: the ids whose earlier versions it ends, which are
those it adds and those it deletes. Reading takes of every document the version that no later segment ends, so document
frequencies, counts and average length are those of a fresh index. The manifest names the segments in order; each change
writes the next version of it last, and readers take the latest, so a change is there as a whole or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.operators.search import SearchIndex, corpus_of
from cratewise.session import delete_folder, materialize

# So many segments of about one size are merged.
FACTOR = 4
_POSTINGS = "term string, doc_id string, col string, tf bigint, positions array<int>"


@dataclass(frozen=True)
class Segment:
    """A named segment with the number of documents it was written with."""

    name: str
    docs: int


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The segments of the latest manifest, oldest first; few, since they are merged by size."""
    rows = spark.read.schema("version bigint, nth int, name string, docs bigint").parquet(f"{path}/manifest")
    latest = rows.agg(F.max("version").alias("version"))
    return [Segment(r["name"], r["docs"]) for r in rows.join(F.broadcast(latest), "version").orderBy("nth").collect()]


def _publish(spark: SparkSession, path: str, listed: list[Segment], fresh: bool) -> None:
    version = 1 if fresh else spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0] + 1
    rows = [(version, i, s.name, s.docs) for i, s in enumerate(listed)]
    table = spark.createDataFrame(rows, "version bigint, nth int, name string, docs bigint")
    table.coalesce(1).write.mode("overwrite" if fresh else "append").parquet(f"{path}/manifest")


def _write(index: SearchIndex, gone: DataFrame, path: str, name: str) -> Segment:
    at = f"{path}/segments/{name}"
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{at}/postings")
    index.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/docs")
    gone.select("doc_id").distinct().write.parquet(f"{at}/gone")
    return Segment(name, index.docs.sparkSession.read.parquet(f"{at}/docs").count())


def create(index: SearchIndex, path: str) -> None:
    """A new index of one segment."""
    spark = index.docs.sparkSession
    first = _write(index, index.docs.select("doc_id").limit(0), path, f"s-{uuid.uuid4().hex}")
    _publish(spark, path, [first], fresh=True)


def change(index: SearchIndex, path: str, deleted: DataFrame | None = None) -> None:
    """Add the documents of ``index`` (those with known ids replace them) and delete the ids of ``deleted(doc_id)``."""
    spark = index.docs.sparkSession
    gone = index.docs.select("doc_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select(F.col("doc_id").cast("string").alias("doc_id")))
    listed = segments(spark, path)
    _publish(spark, path, [*listed, _write(index, gone, path, f"s-{uuid.uuid4().hex}")], fresh=False)


def _tables(spark: SparkSession, path: str, listed: list[Segment]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, documents and ended ids of the segments with their place ``seg`` in the order."""

    def union(part: str, schema: str | None) -> DataFrame:
        whole = None
        for i, s in enumerate(listed):
            reader = spark.read.schema(schema) if schema else spark.read
            table = reader.parquet(f"{path}/segments/{s.name}/{part}").withColumn("seg", F.lit(i))
            whole = table if whole is None else whole.unionByName(table)
        return whole

    return union("postings", _POSTINGS), union("docs", None), union("gone", "doc_id string")


def _live(postings: DataFrame, docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of documents that no later segment ends; what is ended is stored, so joins see how much it is."""
    ended = gone.groupBy("doc_id").agg(F.max("seg").alias("last"))
    dead = materialize(docs.select("doc_id", "seg").join(ended, "doc_id").where("seg < last").select("doc_id", "seg"), "dead").df
    return postings.join(dead, ["doc_id", "seg"], "left_anti"), docs.join(dead, ["doc_id", "seg"], "left_anti")


def read(spark: SparkSession, path: str) -> SearchIndex:
    """The index as it is after all changes."""
    postings, docs = _live(*_tables(spark, path, segments(spark, path)))
    docs = docs.drop("seg")
    return SearchIndex(postings.select("term", "doc_id", "col", "tf", "positions"), docs, corpus_of(docs))


def merge(spark: SparkSession, path: str, factor: int = FACTOR) -> int:
    """Merge the newest segments while ``factor`` of them are of about one size; the number of segments left.

    Segments next to each other are merged from their postings, without the texts. Ids that they end stay ended for
    older segments; the oldest segment has none to end.
    """
    listed = segments(spark, path)
    while len(listed) >= factor and listed[-factor].docs <= factor * sum(s.docs for s in listed[1 - factor :]):
        old, some = listed[:-factor], listed[-factor:]
        postings, docs, gone = _tables(spark, path, some)
        live_postings, live_docs = _live(postings, docs, gone)
        kept = live_docs.drop("seg")
        one = SearchIndex(live_postings.drop("seg"), kept, corpus_of(kept))
        merged = _write(one, gone if old else gone.limit(0), path, f"s-{uuid.uuid4().hex}")
        listed = [*old, merged]
        _publish(spark, path, listed, fresh=False)
        for s in some:  # named by no manifest that a new reader takes
            delete_folder(spark, f"{path}/segments/{s.name}")
    return len(listed)
