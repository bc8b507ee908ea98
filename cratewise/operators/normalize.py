"""Raw records to clean packages. Stateless, so it also runs on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions import text as T
from cratewise.functions import variant as V
from cratewise.functions.category import category_name, category_of_path
from cratewise.sources.snapshot import SHARED_FIELDS, record_ordinal

TEXT_FIELDS = {
    "description": "description",
    "longDescription": "long_description",
    "homepage": "homepage",
    "mainProgram": "main_program",
    "position": "position",
}
OR_FLAGS = ["broken", "unfree", "insecure", "unsupported"]


META_FIELDS = [*TEXT_FIELDS, *OR_FLAGS, "license", "platforms", "maintainers", "category", "available", "outputsToInstall"]


def normalize(records: DataFrame, run_ts: str) -> DataFrame:
    """Clean packages from ``records(line, record)``.

    A record that cannot be normalized (a name or metadata of the wrong type, a broken
    path) is dropped, and so is one without a package name.
    """
    opened = records.where(F.col("record._bad").isNull()).select(
        "line",
        F.col("record.attrPath").alias("attr_v"),
        V.as_text(F.col("record.name")).alias("full_name"),
        V.as_text(F.col("record.drvPath")).alias("drv_path"),
        F.col("record.outputs").alias("outputs_v"),
        *[F.col(f"record.meta.{n}").alias(f"v_{n}") for n in META_FIELDS],
    )
    parts = V.items(F.col("attr_v"))
    pathed = opened.withColumns(
        {"attr_parts": F.transform(parts, lambda v: V.as_text(v)), **{f"k_{n}": V.kind(F.col(f"v_{n}")) for n in META_FIELDS}}
    )
    whole_path = F.col("attr_v").isNull() | ~F.exists("attr_parts", lambda v: v.isNull())
    split = pathed.where(F.coalesce(whole_path, F.lit(False))).withColumns(
        {
            "attribute_path": F.coalesce(F.array_join("attr_parts", "."), F.lit("")),
            "package_name": T.package_name(F.col("full_name")),
            "version": T.package_version(F.col("full_name")),
        }
    )
    split = split.withColumn("path_lower", F.lower("attribute_path"))
    category_v, category_k = F.col("v_category"), F.col("k_category")
    category = F.when(
        V.truthy(category_v, category_k), category_name(V.as_display(category_v, category_k))
    ).otherwise(category_of_path("path_lower"))
    return _clean(split, category, run_ts)


def normalize_map(records: DataFrame, run_ts: str) -> DataFrame:
    """Clean packages from ``records(attr_path, line, record)``, the map-shaped snapshot.

    ``meta`` wins over the top level; this form carries no category.
    """
    opened = records.where(F.col("record._bad").isNull()).select(
        "line",
        F.col("attr_path").alias("attribute_path"),
        F.lit(None).cast("string").alias("drv_path"),
        F.col("record.outputs").alias("outputs_v"),
        F.col("record.pname").alias("name_v"),
        F.col("record.version").alias("version_v"),
        *[_first_truthy(n).alias(f"v_{n}") for n in META_FIELDS],
    )
    last = F.element_at(F.split("attribute_path", r"\."), -1)
    split = opened.withColumns(
        {
            "package_name": F.when(V.truthy(F.col("name_v")), V.as_display(F.col("name_v"))).otherwise(last),
            "version": F.when(V.truthy(F.col("version_v")), V.as_display(F.col("version_v"))).otherwise(T.UNKNOWN),
            **{f"k_{n}": V.kind(F.col(f"v_{n}")) for n in META_FIELDS},
        }
    )
    return _clean(split, F.lit(""), run_ts)


def _first_truthy(name: str) -> Column:
    inner = F.col(f"record.meta.{name}")
    return F.when(V.truthy(inner), inner).otherwise(F.col(f"record.{name}")) if name in SHARED_FIELDS else inner


def _clean(split: DataFrame, category: Column, run_ts: str) -> DataFrame:
    """The clean columns from identity columns and the metadata members with their kinds."""

    def rule(apply: Callable[[Column, Column], Column], name: str) -> Column:
        return apply(F.col(f"v_{name}"), F.col(f"k_{name}"))

    path, name, version = F.col("attribute_path"), F.col("package_name"), F.col("version")
    kept = split.where(~name.isin("", T.UNKNOWN)).withColumn("license_kind", rule(V.license_kind, "license"))
    return kept.select(
        record_ordinal(path, F.col("drv_path"), F.col("line")).alias("ord"),
        T.package_id(path, name, version).alias("package_id"),
        "package_name",
        "version",
        "attribute_path",
        *[rule(V.sanitize, source).alias(target) for source, target in TEXT_FIELDS.items()],
        "license_kind",
        V.license_items(F.col("v_license"), F.col("k_license"), F.col("license_kind")).alias("licenses"),
        rule(V.platforms, "platforms").alias("platforms"),
        rule(V.maintainers, "maintainers").alias("maintainers"),
        category.alias("category"),
        *[rule(V.truthy, flag).alias(flag) for flag in OR_FLAGS],
        rule(V.availability, "available").alias("available"),
        rule(V.text_list, "outputsToInstall").alias("outputs_to_install"),
        F.lit(run_ts).alias("last_updated"),
        F.coalesce("drv_path", F.lit("")).alias("drv_path"),
        F.coalesce(F.to_json("outputs_v"), F.lit("{}")).alias("outputs"),
    )
