"""What a search front end shows and what a request log holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions import variant as V

# Request defaults, accepted flag words, license families and the words they are known by.
DEFAULT_LIMIT = 50
DEFAULT_OFFSET = 0
YES_WORDS = ["1", "true", "yes"]
LICENSE_FAMILIES = {"permissive": ["mit", "bsd"], "copyleft": ["gpl"], "apache": ["apache"]}
UNKNOWN_LICENSE = "Unknown"


def license_display(license_json: Column) -> Column:
    """The short name inside a license JSON text, ``Unknown`` without one."""
    name = V.as_text(V.field(F.try_parse_json(license_json), "shortName"))
    return F.coalesce(F.when(name != "", name), F.lit(UNKNOWN_LICENSE))


def license_list(license_json: Column) -> Column:
    """One-item list for display; ``Unknown`` when the text is not a license."""
    parsed = F.try_parse_json(license_json)
    known = ~V.is_absent(V.kind(parsed))
    return F.when(known, F.array(V.as_text(V.field(parsed, "shortName")))).otherwise(
        F.array(F.lit(UNKNOWN_LICENSE))
    )


def is_free(license_json: Column) -> Column:
    return V.truthy(V.field(F.try_parse_json(license_json), "free"))


def license_family(names: Column) -> Column:
    """The first family any license of the list belongs to, else ``other``."""
    lowered = F.transform(F.coalesce(names, F.array().cast("array<string>")), F.lower)

    def has(words: list[str]) -> Column:
        return F.exists(lowered, lambda n: F.coalesce(n.rlike("|".join(words)), F.lit(False)))

    families = iter(LICENSE_FAMILIES.items())
    family, words = next(families)
    found = F.when(has(words), family)
    for family, words in families:
        found = found.when(has(words), family)
    return found.otherwise("other")


def enrich_results(results: DataFrame) -> DataFrame:
    """License list, ``unfree`` from the license, and defaults for missing optional fields."""
    known = ~V.is_absent(V.kind(F.try_parse_json(F.col("license"))))
    return results.withColumns(
        {
            "license_list": license_list(F.col("license")),
            "unfree": known & ~is_free(F.col("license")),
            "category": F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("misc")),
            "maintainers": F.coalesce(F.col("maintainers"), F.array().cast(results.schema["maintainers"].dataType)),
            "platforms": F.coalesce(F.col("platforms"), F.array().cast("array<string>")),
            "broken": F.coalesce(F.col("broken"), F.lit(False)),
        }
    )


def request_columns(params: Column) -> dict[str, Column]:
    """Typed request fields from a ``map<string,string>`` of query parameters."""

    def whole(name: str, default: int) -> Column:
        # A whole number as a 32-bit parser takes it: optional sign, digits, no blanks.
        text = F.when(params[name].rlike(r"^[+-]?[0-9]+$"), params[name])
        return F.coalesce(text.try_cast("int"), F.lit(default))

    def flag(name: str) -> Column:
        return F.coalesce(F.lower(params[name]).isin(YES_WORDS), F.lit(False))

    return {
        "q": F.coalesce(params["q"], F.lit("")),
        "limit": whole("limit", DEFAULT_LIMIT),
        "offset": whole("offset", DEFAULT_OFFSET),
        "license": params["license"],
        "category": params["category"],
        "include_broken": flag("include_broken"),
        "include_unfree": flag("include_unfree"),
    }


# Result column -> name in the answer; the second group is left out when null.
RESULT_FIELDS = {
    "package_id": "packageId",
    "package_name": "packageName",
    "version": "version",
    "description": "description",
    "homepage": "homepage",
    "license": "license",
    "attribute_path": "attributePath",
    "category": "category",
    "broken": "broken",
    "unfree": "unfree",
    "available": "available",
    "relevance_score": "relevanceScore",
}
OPTIONAL_FIELDS = {
    "maintainers": "maintainers",
    "platforms": "platforms",
    "long_description": "longDescription",
    "main_program": "mainProgram",
    "position": "position",
    "outputs_to_install": "outputsToInstall",
    "last_updated": "lastUpdated",
}


def result_json(columns: list[str]) -> Column:
    """One search hit as a JSON text; ``to_json`` leaves null fields out."""
    names = {**RESULT_FIELDS, **OPTIONAL_FIELDS}
    return F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items() if c in columns]))


def package_json(columns: list[str]) -> Column:
    """One package of an answer: twelve fields always, null where unknown, and the other seven where they are known."""
    shown = [F.col(c).alias(n) for c, n in RESULT_FIELDS.items() if c in columns]
    more = [F.col(c).alias(n) for c, n in OPTIONAL_FIELDS.items() if c in columns]
    always = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    if not more:
        return always
    rest = F.to_json(F.struct(*more))
    return F.when(rest == "{}", always).otherwise(F.concat(F.regexp_replace(always, r"\}$", ","), F.substring(rest, 2, 2**31 - 1)))


def search_answers(requests: DataFrame, hits: DataFrame, search_type: str = "fts") -> DataFrame:
    """``(request_id, body)``: the answer to every request as JSON.

    ``requests`` has request_id, query and query_time_ms; ``hits`` one row per package of a request's page with request_id, rank,
    total_count and the package's columns, best first by rank. A request without hits has an empty list and the total 0.
    """
    page = hits.select("request_id", "rank", "total_count", package_json(hits.columns).alias("json"))
    pages = page.groupBy("request_id").agg(
        F.max("total_count").alias("total_count"), F.sort_array(F.collect_list(F.struct("rank", "json"))).alias("rows")
    )
    head = F.to_json(
        F.struct(
            F.lit("Search completed").alias("message"),
            F.col("query"),
            F.coalesce("total_count", F.lit(0)).alias("total_count"),
            F.col("query_time_ms").cast("double").alias("query_time_ms"),
            F.lit(search_type).alias("search_type"),
        ),
        {"ignoreNullFields": "false"},
    )
    packages = F.coalesce(F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit(""))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"packages":['), packages, F.lit("]}"))
    return requests.join(pages, "request_id", "left").select("request_id", body.alias("body"))
