"""Data-quality counts: coverage, integrity, keys, sizes and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cratewise.operators.star import Catalog

# Keys and references of the star schema.
PRIMARY_KEYS = {
    "packages": ["package_id"],
    "licenses": ["license_id"],
    "architectures": ["arch_id"],
    "maintainers": ["maintainer_id"],
    "package_licenses": ["package_id", "license_id"],
    "package_architectures": ["package_id", "arch_id"],
    "package_maintainers": ["package_id", "maintainer_id"],
    "package_variations": ["variation_id"],
}
UNIQUE_KEYS = {
    "licenses": ["short_name"],
    "architectures": ["name"],
    "maintainers": ["name", "email", "github"],
    "package_variations": ["package_id", "system"],
}
REFERENCES = [
    ("package_licenses", "package_id", "packages"),
    ("package_licenses", "license_id", "licenses"),
    ("package_architectures", "package_id", "packages"),
    ("package_architectures", "arch_id", "architectures"),
    ("package_maintainers", "package_id", "packages"),
    ("package_maintainers", "maintainer_id", "maintainers"),
    ("package_variations", "package_id", "packages"),
]


def coverage(documents: DataFrame) -> DataFrame:
    """How many packages have a license, maintainers and platforms."""
    return documents.agg(
        F.count(F.lit(1)).alias("packages"),
        F.count_if(F.size("licenses") > 0).alias("with_license"),
        F.count_if(F.size("maintainers") > 0).alias("with_maintainers"),
        F.count_if(F.size("platforms") > 0).alias("with_platforms"),
    )


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(table: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    return table.join(lookup.select(column), column, "left_anti")


def key_violations(catalog: Catalog) -> DataFrame:
    """``(rule, violations)`` for every primary key, unique key and reference of the star schema."""
    tables = catalog.tables()
    checks = {}
    for kind, keys in [("primary key", PRIMARY_KEYS), ("unique key", UNIQUE_KEYS)]:
        for name, columns in keys.items():
            checks[f"{kind} {name}({', '.join(columns)})"] = repeated_keys(tables[name], columns)
    for name, column, lookup in REFERENCES:
        checks[f"reference {name}.{column}"] = orphans(tables[name], column, tables[lookup])
    counts = [c.agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(r)) for r, c in checks.items()]
    whole = counts[0]
    for count in counts[1:]:
        whole = whole.unionByName(count)
    return whole.select("rule", "violations")


def index_matches_store(index_docs: DataFrame, store: DataFrame) -> DataFrame:
    """One row: rows on both sides, and the ids that only one side has."""
    left = index_docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("in_index"), F.lit(0).alias("in_store"))
    right = store.select("id", F.lit(0).alias("in_index"), F.lit(1).alias("in_store"))
    ids = left.unionByName(right).groupBy("id").agg(F.sum("in_index").alias("i"), F.sum("in_store").alias("s"))
    zero = F.lit(0).cast("bigint")
    return ids.agg(
        F.coalesce(F.sum("i"), zero).alias("index_rows"),
        F.coalesce(F.sum("s"), zero).alias("store_rows"),
        F.count_if(F.col("s") == 0).alias("only_in_index"),
        F.count_if(F.col("i") == 0).alias("only_in_store"),
    )


def verify_output(spark: SparkSession, store_path: str, index_path: str) -> dict[str, bool]:
    """Are the tables there, does a document decode, do index and store agree?"""
    from cratewise.operators.search import read_index
    from cratewise.sources.documents import decode_documents

    store, index = spark.read.parquet(store_path), read_index(spark, index_path)
    one = decode_documents(store.limit(1)).select("is_stub", "package_name").collect()
    agree = index_matches_store(index.docs, store).first()
    return {
        "tables_present": {"id", "doc"} <= set(store.columns) and {"term", "doc_id"} <= set(index.postings.columns),
        "document_decodes": bool(one) and not one[0]["is_stub"],
        "index_matches_store": agree["only_in_index"] == 0 and agree["only_in_store"] == 0,
    }


def storage_stats(store: DataFrame, stored_bytes: int | Column | None = None) -> DataFrame:
    """Documents, raw bytes, stored bytes and the saving in percent."""
    raw = F.coalesce(F.sum(F.octet_length("doc")), F.lit(0))
    stats = store.agg(F.count(F.lit(1)).alias("total_documents"), raw.cast("bigint").alias("raw_bytes"))
    if stored_bytes is None:
        return stats
    stored = F.lit(stored_bytes).cast("bigint") if isinstance(stored_bytes, int) else stored_bytes
    saving = F.when(F.col("raw_bytes") > 0, (1 - F.col("stored_bytes") / F.col("raw_bytes")) * 100).otherwise(0.0)
    return stats.withColumn("stored_bytes", stored).withColumn("saving_percent", saving)


def folder_bytes(spark: SparkSession, path: str, suffix: str = ".parquet") -> int:
    """Bytes of the files below a folder; only their listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)
    return files.load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def round_trip_differences(before: DataFrame, after: DataFrame, key: str = "id", value: str = "doc") -> DataFrame:
    """``(key, before, after)`` of the rows that did not come back as they were."""
    left = before.select(key, F.col(value).alias("before"))
    right = after.select(key, F.col(value).alias("after"))
    return left.join(right, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def count_writes(documents: DataFrame, valid: Column) -> tuple[DataFrame, Observation]:
    """The valid documents, and an observation with success, errors and total once they are written."""
    seen = Observation()
    counted = documents.observe(
        seen,
        F.count_if(valid).alias("success"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("errors"),
        F.count(F.lit(1)).alias("total"),
    )
    return counted.where(valid), seen


def normalization_counts(records: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: records of a snapshot, those that normalization kept, and those that it dropped."""
    read = records.agg(F.count(F.lit(1)).alias("records"))
    kept = packages.agg(F.count(F.lit(1)).alias("kept"))
    return read.crossJoin(kept).withColumn("dropped", F.col("records") - F.col("kept"))  # a row each
