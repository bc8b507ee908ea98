"""The star schema: lookups, links and the package table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import search_text
from cratewise.operators.merge import MAINTAINER_KEY, merge_variants, variations
from cratewise.operators.sequence import number_rows
from cratewise.operators.skew import even_join
from cratewise.session import materialize

LICENSE_COLUMNS = {
    "full_name": "fullName",
    "spdx_id": "spdxId",
    "url": "url",
    "is_free": "free",
    "is_redistributable": "redistributable",
    "is_deprecated": "deprecated",
}


@dataclass
class Catalog:
    """The eight tables, in the order they are written."""

    packages: DataFrame
    licenses: DataFrame
    architectures: DataFrame
    maintainers: DataFrame
    package_licenses: DataFrame
    package_architectures: DataFrame
    package_maintainers: DataFrame
    package_variations: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def with_key(lookup: DataFrame, order: list[str], name: str, keys: str = "sequential") -> DataFrame:
    """A surrogate key: consecutive in natural-key order, or a hash that needs no coordination."""
    if keys == "hash":
        return lookup.withColumn(name, F.xxhash64(*order))
    return number_rows(lookup, order, name)


def license_lookup(packages: DataFrame) -> DataFrame:
    """Distinct licenses by short name over all variants; the last definition wins."""
    one = packages.select("ord", F.posexplode("licenses").alias("pos", "l")).where(F.col("l.shortName") != "")
    last = one.groupBy(F.col("l.shortName").alias("short_name")).agg(
        F.max_by("l", F.struct("ord", "pos")).alias("l")
    )
    return last.select("short_name", *[F.col(f"l.{source}").alias(c) for c, source in LICENSE_COLUMNS.items()])


def architecture_lookup(packages: DataFrame) -> DataFrame:
    return packages.select(F.explode("platforms").alias("name")).distinct()


def maintainer_lookup(packages: DataFrame) -> DataFrame:
    """Distinct (name, email, github); the first variant gives the id; all-empty keys dropped."""
    one = packages.select("ord", F.posexplode("maintainers").alias("pos", "m")).select(
        F.struct("ord", "pos").alias("at"), "m.*"
    )
    return (
        one.where(F.concat(*MAINTAINER_KEY) != "")
        .groupBy(*MAINTAINER_KEY)
        .agg(F.min_by("githubId", "at").alias("github_id"))
    )


def license_links(merged: DataFrame, licenses: DataFrame) -> DataFrame:
    names = merged.select("package_id", F.explode("licenses.shortName").alias("short_name")).distinct()
    return even_join(names, licenses.select("short_name", "license_id"), "short_name").select("package_id", "license_id")


def architecture_links(merged: DataFrame, architectures: DataFrame) -> DataFrame:
    names = merged.select("package_id", F.explode("platforms").alias("name")).distinct()
    return even_join(names, architectures, "name").select("package_id", "arch_id")


def maintainer_links(merged: DataFrame, maintainers: DataFrame, match: str = "exact") -> DataFrame:
    """Package–maintainer links on the whole key, or on any one equal field (``match="any"``).

    With ``any`` an empty field never matches: it says nothing about who someone is, and
    pairing every package with every maintainer that lacks an address is quadratic.
    """
    named = merged.select("package_id", F.explode("maintainers").alias("m")).select("package_id", "m.*")
    if match == "exact":
        return (
            named.select("package_id", *MAINTAINER_KEY)
            .distinct()
            .join(maintainers.select(*MAINTAINER_KEY, "maintainer_id"), MAINTAINER_KEY)
            .select("package_id", "maintainer_id")
        )
    if match != "any":
        raise ValueError(f"match must be 'exact' or 'any', not {match!r}")

    def on(column: str) -> DataFrame:
        filled = F.col(column) != ""
        left = named.where(filled).select("package_id", column).distinct()
        return left.join(maintainers.where(filled).select(column, "maintainer_id"), column).select(
            "package_id", "maintainer_id"
        )

    return on("name").unionByName(on("email")).unionByName(on("github")).distinct()


def package_table(merged: DataFrame) -> DataFrame:
    """The package rows; ``content_hash`` covers the nested lists as well."""
    plain = {c: F.coalesce(c, F.lit("")) for c in PACKAGE_TEXTS}
    rows = merged.withColumns(plain).withColumn(
        "search_text",
        search_text(*[F.col(c) for c in ["package_name", "description", "long_description", "attribute_path", "main_program"]]),
    )
    return rows.select(
        "package_id",
        "package_name",
        "version",
        "attribute_path",
        "description",
        "long_description",
        "search_text",
        "homepage",
        "category",
        "broken",
        "unfree",
        "available",
        "insecure",
        "unsupported",
        "main_program",
        "position",
        encode_list(F.col("outputs_to_install")).alias("outputs_to_install"),
        "last_updated",
        content_hash(rows).alias("content_hash"),
    )


PACKAGE_TEXTS = [
    "package_name",
    "version",
    "attribute_path",
    "description",
    "long_description",
    "homepage",
    "category",
    "main_program",
    "position",
    "last_updated",
]


def encode_list(items: Column) -> Column:
    """A list as JSON text, the empty string for an empty one."""
    return F.when(F.size(items) > 0, F.to_json(items)).otherwise("")


def decode_list(text: Column) -> Column:
    return F.when(text != "", F.from_json(text, "array<string>"))


def content_hash(rows: DataFrame) -> Column:
    """Hash of a package's content: everything but its ordinal and the run time."""
    content = [c for c in rows.columns if c not in ("ord", "last_updated")]
    return F.xxhash64(F.to_json(F.struct(*sorted(content))))


def build_catalog(packages: DataFrame, keys: str = "sequential", match: str = "exact") -> Catalog:
    """All eight tables from normalized variants; pass a stored or cached DataFrame, it is read several times."""
    merged = materialize(merge_variants(packages), "merged").df
    licenses = with_key(license_lookup(packages), ["short_name"], "license_id", keys)
    architectures = with_key(architecture_lookup(packages), ["name"], "arch_id", keys)
    maintainers = with_key(maintainer_lookup(packages), MAINTAINER_KEY, "maintainer_id", keys)
    return Catalog(
        packages=package_table(merged),
        licenses=licenses,
        architectures=architectures,
        maintainers=maintainers,
        package_licenses=license_links(merged, licenses),
        package_architectures=architecture_links(merged, architectures),
        package_maintainers=maintainer_links(merged, maintainers, match),
        package_variations=variations(packages),
    )
