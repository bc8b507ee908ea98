"""Session defaults and the shared working folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "cratewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where that costs one more shuffle afterwards.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def working_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one in the shared warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_working").rstrip("/")


_RUN_FOLDERS: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The session's own folder in the working folder; it is deleted when the driver ends."""
    path = f"{working_folder(spark)}/{spark.sparkContext.applicationId}"
    if path not in _RUN_FOLDERS:
        _RUN_FOLDERS.add(path)
        atexit.register(_clean_up, spark, path)
    return path


def _clean_up(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete_folder(spark, path)


@dataclass
class Stored:
    """A DataFrame written to the working folder and read back, with its row count."""

    df: DataFrame
    rows: int
    path: str
    checksum: int = 0

    def drop(self) -> None:
        """Delete the files; for rounds of a loop that nothing reads any more."""
        delete_folder(self.df.sparkSession, self.path)


def materialize(df: DataFrame, label: str = "step") -> Stored:
    """Cut lineage by writing ``df`` as Parquet; the row count comes from the same job.

    A written table survives lost executors, is columnar, and gives Catalyst real
    sizes, so the next join picks its strategy from facts. Row count and checksum tell
    a loop whether a round changed anything.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    checksum = F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), checksum).write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path, seen.get["checksum"])


def read_stored(parts: list[Stored]) -> DataFrame:
    """All parts as one flat scan (no growing union plan)."""
    first = parts[0].df
    return first.sparkSession.read.schema(first.schema).parquet(*[p.path for p in parts])


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
