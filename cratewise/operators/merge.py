"""One package out of its per-platform variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import system_of
from cratewise.operators.normalize import OR_FLAGS

FIRST_FILLED = ["description", "long_description", "homepage", "category", "main_program"]
FROM_FIRST = ["package_name", "version", "attribute_path", "position", "outputs_to_install", "last_updated"]
MAINTAINER_KEY = ["name", "email", "github"]


def package_platforms(packages: DataFrame) -> DataFrame:
    """Distinct ``(package_id, platform)`` over all variants."""
    return packages.select("package_id", F.explode("platforms").alias("platform")).distinct()


def package_maintainers(packages: DataFrame) -> DataFrame:
    """One row per package and maintainer key, with the last variant's ``githubId``; empty keys dropped."""
    m = packages.select("package_id", "ord", F.posexplode("maintainers").alias("pos", "m")).select(
        "package_id", F.struct("ord", "pos").alias("at"), "m.*"
    )
    named = m.where(F.concat(*MAINTAINER_KEY) != "")
    return named.groupBy("package_id", *MAINTAINER_KEY).agg(F.max_by("githubId", "at").alias("githubId"))


def merge_variants(packages: DataFrame) -> DataFrame:
    """One row per ``package_id``.

    The scalar part is one aggregation with map-side combine, so a package with very many
    variants sends one row per map task. Lists are made distinct as rows before they are
    gathered, so an array holds each platform or maintainer of a package once and never
    the variants themselves. All three parts are hashed on ``package_id`` and join in place.
    """
    filled = [F.min_by(c, F.when(F.col(c) != "", F.col("ord"))).alias(c) for c in FIRST_FILLED]
    license_parts = F.struct("license_kind", "licenses")
    scalars = packages.groupBy("package_id").agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct(*FROM_FIRST), "ord").alias("base"),
        *filled,
        F.min_by(license_parts, F.when(F.col("license_kind").isNotNull(), F.col("ord"))).alias("license"),
        *[F.bool_or(flag).alias(flag) for flag in OR_FLAGS],
        F.bool_and("available").alias("available"),
    )
    platforms = (
        package_platforms(packages)
        .groupBy("package_id")
        .agg(F.sort_array(F.collect_list("platform")).alias("platforms"))
    )
    maintainers = (
        package_maintainers(packages)
        .groupBy("package_id")
        .agg(F.sort_array(F.collect_list(F.struct(*MAINTAINER_KEY, "githubId"))).alias("maintainers"))
    )
    return (
        scalars.join(platforms, "package_id", "left")
        .join(maintainers, "package_id", "left")
        .select(
            "package_id",
            "ord",
            *[F.col(f"base.{c}").alias(c) for c in FROM_FIRST],
            *[F.coalesce(c, F.lit("")).alias(c) for c in FIRST_FILLED],
            "license.license_kind",
            "license.licenses",
            "platforms",
            "maintainers",
            *OR_FLAGS,
            "available",
        )
    )


def variations(packages: DataFrame) -> DataFrame:
    """One row per package and system, from all variants; the last variant wins."""
    return (
        packages.withColumn("system", system_of(F.col("attribute_path")))
        .where(F.col("system") != "")
        .groupBy("package_id", "system")
        .agg(F.max_by(F.struct("drv_path", "outputs"), "ord").alias("last"))
        .select(
            F.concat_ws(".", "package_id", "system").alias("variation_id"),
            "package_id",
            "system",
            "last.drv_path",
            "last.outputs",
        )
    )
