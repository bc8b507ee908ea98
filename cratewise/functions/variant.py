"""Rules for polymorphic JSON fields held as VARIANT.

The rules take the value and, where a caller has it as a column already, its kind, so that
neither is worked out again in every branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratewise.functions.text import clean_text

LICENSE_TEXTS = ["shortName", "fullName", "spdxId", "url"]
LICENSE_FLAGS = ["free", "redistributable", "deprecated"]
LICENSE_ITEM = (
    "struct<" + ",".join([f"{n}:string" for n in LICENSE_TEXTS] + [f"{n}:boolean" for n in LICENSE_FLAGS]) + ">"
)
MAINTAINER_ITEM = "struct<name:string,email:string,github:string,githubId:bigint>"


def field(value: Column, name: str) -> Column:
    """A member as VARIANT: null when missing, variant null when explicitly null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """``STRING``, ``BOOLEAN``, ``VOID``, ``ARRAY<...``, ``OBJECT<...`` or a number type; null when missing."""
    return F.schema_of_variant(value)


def is_kind(k: Column, name: str) -> Column:
    return F.coalesce(k.startswith(name), F.lit(False))


def is_absent(k: Column) -> Column:
    """Missing or explicitly null."""
    return F.coalesce(k == "VOID", F.lit(True))


def as_text(value: Column, k: Column | None = None) -> Column:
    """The text of a string member, null for anything else."""
    return F.when((kind(value) if k is None else k) == "STRING", _string(value))


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def tagged(value: Column) -> Column:
    """The items of a list with their kinds, ``array<struct<v,k>>``, so that rules per item read the kind once."""
    return F.transform(items(value), lambda v: F.struct(v.alias("v"), kind(v).alias("k")))


def truthy(value: Column, k: Column | None = None) -> Column:
    """False for missing, null, false, 0, empty text, empty list and empty object."""
    k = kind(value) if k is None else k
    return (
        F.when(k.isNull() | (k == "VOID"), False)
        .when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(k == "STRING", _string(value) != "")
        .when(k.startswith("ARRAY"), F.size(items(value)) > 0)
        .when(k.startswith("OBJECT"), k != "OBJECT<>")
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def as_display(value: Column, k: Column | None = None) -> Column:
    """Any member as text the way a scripting language prints it."""
    k = kind(value) if k is None else k
    return (
        F.when(k == "STRING", _string(value))
        .when(k == "VOID", "None")
        .when(k == "BOOLEAN", F.initcap(_string(value)))
        .when(k.startswith("ARRAY") | k.startswith("OBJECT"), F.to_json(value))
        .otherwise(_string(value))
    )


def sanitize(value: Column, k: Column | None = None) -> Column:
    """Clean text of a string member, the empty string for anything else."""
    return F.coalesce(clean_text(as_text(value, k)), F.lit(""))


def _only_boolean(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def _license_item(item: Column) -> Column:
    value, k = item["v"], item["k"]
    named = F.struct(
        *[sanitize(field(value, n)).alias(n) for n in LICENSE_TEXTS],
        *[_only_boolean(field(value, n)).alias(n) for n in LICENSE_FLAGS],
    )
    return F.when(k.startswith("OBJECT"), named).otherwise(short_license(as_display(value, k)))


def short_license(name: Column) -> Column:
    """A license known by its short name only."""
    blank = [F.lit("").alias(n) for n in LICENSE_TEXTS[1:]]
    unset = [F.lit(None).cast("boolean").alias(n) for n in LICENSE_FLAGS]
    return F.struct(name.alias("shortName"), *blank, *unset)


def license_kind(value: Column, k: Column) -> Column:
    """``string``, ``array`` or ``object``; null for a missing or empty license."""
    name = F.when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("string")
    return F.when(truthy(value, k), name)


def license_items(value: Column, k: Column, typed: Column) -> Column:
    """All licenses of the member as one list; a plain text becomes a short name.

    ``typed`` is the result of ``license_kind``.
    """
    plain = F.when(k == "STRING", sanitize(value, k)).otherwise(as_display(value, k))
    several = F.when(typed == "array", F.filter(tagged(value), lambda e: truthy(e["v"], e["k"]))).when(
        typed == "object", F.array(F.struct(value.alias("v"), k.alias("k")))
    )
    return (
        F.when(typed == "string", F.array(short_license(plain)))
        .otherwise(F.transform(several, _license_item))
        .cast(f"array<{LICENSE_ITEM}>")
    )


def platforms(value: Column, k: Column, cap: int | None = None) -> Column:
    """The text items, empty for anything but a list; with ``cap``, those among the first so many items."""
    listed = items(value) if cap is None else F.slice(items(value), 1, cap)
    kept = F.transform(listed, lambda v: as_text(v))
    return F.when(is_kind(k, "ARRAY"), F.array_compact(kept)).otherwise(F.array().cast("array<string>"))


def maintainers(value: Column, k: Column, cap: int | None = None) -> Column:
    """Objects with any of name, email, github, and other items by name; with ``cap``, the first so many that stay."""
    blank, no_id = F.lit(""), F.lit(None).cast("bigint")

    def entry(item: Column) -> Column:
        value, is_object = item["v"], item["k"].startswith("OBJECT")
        number = field(value, "githubId")
        known = F.struct(
            *[sanitize(field(value, n)).alias(n) for n in ["name", "email", "github"]],
            F.when(kind(number) == "BIGINT", F.try_variant_get(number, "$", "bigint")).alias("githubId"),
        )
        other = F.struct(
            as_display(value, item["k"]).alias("name"), blank.alias("email"), blank.alias("github"), no_id.alias("githubId")
        )
        return F.struct(F.when(is_object, known).otherwise(other).alias("m"), is_object.alias("is_object"))

    def stays(e: Column) -> Column:
        m = e["m"]
        return ~e["is_object"] | (F.concat(m["name"], m["email"], m["github"]) != "")

    kept = F.filter(F.transform(tagged(value), entry), stays)
    kept = kept if cap is None else F.slice(kept, 1, cap)
    empty = F.array().cast(f"array<{MAINTAINER_ITEM}>")
    return F.when(is_kind(k, "ARRAY"), F.transform(kept, lambda e: e["m"])).otherwise(empty)


def text_list(value: Column, k: Column) -> Column:
    """A list with its items as text, empty for anything but a list."""
    texts = F.transform(items(value), lambda v: F.coalesce(as_text(v), F.to_json(v)))
    return F.when(is_kind(k, "ARRAY"), texts).otherwise(F.array().cast("array<string>"))


def only_texts(value: Column) -> Column:
    """The text items of a list, null for anything but a list."""
    return F.when(is_kind(kind(value), "ARRAY"), F.array_compact(F.transform(items(value), lambda v: as_text(v))))


def availability(value: Column, k: Column) -> Column:
    """Missing means available; an explicit null means it is not."""
    return F.when(k.isNull(), True).otherwise(truthy(value, k))
