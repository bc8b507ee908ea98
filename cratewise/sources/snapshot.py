"""Package snapshots: line-delimited JSON with an optional header line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cratewise.functions import variant as V

# Header key, header fields and the extractor name written by default.
HEADER_KEY = "_metadata"
HEADER_SCHEMA = (
    "extraction_timestamp string, nixpkgs_branch string, total_packages bigint, "
    "extractor_version string, original_file string"
)
EXTRACTOR = "cratewise-1"


# The members that are read, each as it comes; ``_bad`` holds lines that do not fit.
_TOP = ["attrPath", "name", "drvPath", "outputs", "inputDrvs", "pname", "version", HEADER_KEY]
SHARED_FIELDS = ["description", "homepage", "license", "platforms", "maintainers", "broken", "unfree"]
_META = [
    *SHARED_FIELDS,
    "longDescription",
    "mainProgram",
    "position",
    "category",
    "insecure",
    "unsupported",
    "available",
    "outputsToInstall",
]
RECORD_SCHEMA = (
    ", ".join(f"{n} variant" for n in [*_TOP, *SHARED_FIELDS])
    + ", meta struct<"
    + ", ".join(f"{n}: variant" for n in _META)
    + ">, _bad string"
)


@dataclass
class Snapshot:
    """``records(line, record)``, the one-row ``header`` and the unparsable lines ``bad(line)``."""

    records: DataFrame
    header: DataFrame
    bad: DataFrame


def parse_record(text: Column) -> Column:
    """The read members of one JSON record as a struct, each a VARIANT of its own.

    One pass over the text that builds nothing for members nobody reads. Metadata of the
    wrong type leave the text in ``_bad``.
    """
    return F.from_json(text, RECORD_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})


def parsed_once(lines: DataFrame) -> DataFrame:
    """``(line, record)``; a blank line has no record.

    The one-element explode keeps the optimizer from copying the parse into every filter and
    projection above it.
    """
    return lines.select("*", F.explode(F.array(parse_record(F.col("line")))).alias("record"))


def parse_lines(lines: DataFrame) -> Snapshot:
    """Split text lines into records, header and unparsable lines; blank lines are skipped.

    Works on a stream as well: every step looks at one line only.
    """
    parsed = parsed_once(lines.select(F.col("value").alias("line")))
    meta = F.col(f"record.{HEADER_KEY}")
    # Only a line that does not fit is parsed again, to tell broken JSON from odd members.
    broken = F.coalesce(F.col("record._bad").isNotNull() & F.try_parse_json("line").isNull(), F.lit(False))
    header = parsed.where(V.is_kind(V.kind(meta), "OBJECT")).select(
        F.from_json(F.to_json(meta), HEADER_SCHEMA).alias("h")
    )
    return Snapshot(
        records=parsed.where(F.col("record").isNotNull() & meta.isNull() & ~broken),
        header=header.select("h.*"),
        bad=parsed.where(broken).select("line"),
    )


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot from text files; gzip and zstd files are decompressed by the reader."""
    return parse_lines(spark.read.text(path))


def read_snapshot_map(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``records(attr_path, line, record)`` from JSON objects keyed by attribute path.

    One object per line, or per file with ``whole_files``; each object is one row, so
    a catalog should come as many objects, not as a single one.
    """
    return explode_map(spark.read.text(path, wholetext=whole_files))


def explode_map(objects: DataFrame) -> DataFrame:
    """One row per entry of the objects in ``value``; the entry's own text is parsed like a line."""
    entries = objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("attr_path", "line"))
    return parsed_once(entries)


def write_snapshot(
    lines: DataFrame,
    path: str,
    branch: str,
    run_ts: str,
    original_file: str = "",
    extractor: str = EXTRACTOR,
    compression: str = "gzip",
) -> DataFrame:
    """Write the ``value`` lines below ``path/data`` and a one-row header below ``path/header``.

    The header is a file of its own that the reader picks up with the rest
    (``read_snapshot(spark, path + "/*")``), so counting and writing take one pass.
    Returns the manifest: header fields, raw and stored bytes.
    """
    spark = lines.sparkSession
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith('{"' + HEADER_KEY + '"'))
    seen = Observation()
    counted = kept.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("raw_bytes"),
    )
    counted.select("value").write.mode("overwrite").text(f"{path}/data", compression=compression)
    rows, raw_bytes = seen.get["rows"], seen.get["raw_bytes"]
    stored = (
        spark.read.format("binaryFile").load(f"{path}/data").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"))
    )
    header = spark.range(1).select(
        F.lit(run_ts).alias("extraction_timestamp"),
        F.lit(branch).alias("nixpkgs_branch"),
        F.lit(rows).cast("bigint").alias("total_packages"),
        F.lit(extractor).alias("extractor_version"),
        F.lit(original_file).alias("original_file"),
    )
    header.select(F.to_json(F.struct(F.struct("*").alias(HEADER_KEY))).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/header", compression=compression)
    return header.withColumns(
        {"raw_bytes": F.lit(raw_bytes).cast("bigint"), "stored_bytes": F.lit(stored.first()["n"]).cast("bigint")}
    )


def record_ordinal(attr_path: Column, drv_path: Column, line: Column) -> Column:
    """The order that decides "first" and "last": by path, then derivation, then content."""
    return F.struct(
        attr_path.alias("attr_path"), F.coalesce(drv_path, F.lit("")).alias("drv_path"), F.xxhash64(line).alias("tie")
    )
