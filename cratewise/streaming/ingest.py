"""Normalization of arriving snapshot files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from cratewise.operators.normalize import normalize
from cratewise.sources.snapshot import parse_lines


def ingest_snapshots(
    spark: SparkSession, source: str, target: str, progress: str, run_ts: str, files_per_trigger: int = 1000
) -> StreamingQuery:
    """Normalize the files that arrived below ``source`` since the last run, and stop.

    The batch expressions are stateless, so the same plan runs on the stream; ``progress``
    keeps which files are done, and the Parquet sink writes each batch exactly once.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source)
    packages = normalize(parse_lines(lines).records, run_ts)
    return (
        packages.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
