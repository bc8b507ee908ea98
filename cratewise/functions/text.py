"""String rules: names, versions, identifiers, clean text, tokens."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The word for a missing part, and the words that mark a platform segment.
UNKNOWN = "unknown"
PLATFORM_WORDS = ["linux", "darwin", "windows"]

# The characters that count as blank, Unicode white space plus the four ASCII separators.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A version part starts with a digit (superscripts and subscripts count) or a "v".
_V = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉v]"
# Name before the first version part, or before the last part where none is a version. A name that
# starts with a version part, or with a dash and one, is left whole.
_NAME = rf"(?s)^(?!-?{_V})(?:(.+?)-{_V}.*|(.*)-[^-]*)$"
# From the first version part on, or the last part.
_VERSION = rf"(?s)^(?:(?:.*?-)??({_V}.*)|.*-([^-]*))$"


def trim_text(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def clean_text(text: Column, cap: int | None = None) -> Column:
    """NULs out and trimmed; cut to ``cap`` characters only if asked to."""
    clean = trim_text(F.replace(text, F.lit("\u0000"), F.lit("")))
    return clean if cap is None else F.substring(clean, 1, cap)


def package_name(name: Column) -> Column:
    """The part of ``name`` before its version; one pattern match per row."""
    return F.when(F.coalesce(name, F.lit("")) == "", UNKNOWN).otherwise(F.regexp_replace(name, _NAME, "$1$2"))


def package_version(name: Column) -> Column:
    """The part of ``name`` from the first dash-part that starts like a version."""
    has_parts = F.coalesce(name.contains("-"), F.lit(False))
    return F.when(has_parts, F.regexp_replace(name, _VERSION, "$1$2")).otherwise(UNKNOWN)


def name_from_store_path(path: Column) -> Column:
    """``/store/<hash>-<name>-<version>`` to the name; null without a dash in the last segment."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(base.contains("-"), package_name(F.regexp_extract(base, r"(?s)^[^-]*-(.*)$", 1)))


def package_id(attr_path: Column, name: Column, version: Column) -> Column:
    """Attribute path without its platform segment, else ``name@version``, else ``unknown``."""
    path = trim_text(F.coalesce(attr_path, F.lit("")))
    name = trim_text(F.coalesce(name, F.lit("")))
    version = trim_text(F.coalesce(version, F.lit("")))
    last = F.substring_index(path, ".", -1)  # all of a path without a dot
    without_last = F.substr(path, F.lit(1), F.length(path) - F.length(last) - 1)
    of_platform = reduce(or_, [last.contains(w) for w in PLATFORM_WORDS]) & path.contains(".")
    return (
        F.when(of_platform, without_last)
        .when(path != "", path)
        .when((name != "") | (version != ""), F.concat(name, F.lit("@"), version))
        .otherwise(UNKNOWN)
    )


def node_id(name: Column, version: Column) -> Column:
    return F.concat_ws("-", name, version)


def system_of(attr_path: Column) -> Column:
    """The last dotted segment when there are at least two, else the empty string."""
    return F.coalesce(F.regexp_extract(attr_path, r"(?s)\.([^.]*)$", 1), F.lit(""))


def search_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def display_name(attr_path: Column) -> Column:
    """The attribute path without its leading repository name."""
    return F.regexp_replace(F.coalesce(attr_path, F.lit("")), r"^nixpkgs\.", "")


def token_estimate(text: Column) -> Column:
    """The larger of characters div 4 and the white-space word count."""
    words = F.size(F.filter(F.split(text, f"[{_BLANKS}]+"), lambda w: w != ""))
    return F.greatest(F.floor(F.length(text) / 4), words.cast("bigint"))


def _latin_folding() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to one ASCII letter plus marks, and that letter."""
    marked, plain = [], []
    for code in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_folding()
# Combining marks have no counterpart in the replacement text, so translate() deletes them.
_COMBINING = "".join(chr(c) for c in range(0x0300, 0x0370))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, numbers and private-use characters, Latin accents removed."""
    folded = F.translate(F.lower(text), _MARKED + _COMBINING, _PLAIN)
    return F.filter(F.split(F.coalesce(folded, F.lit("")), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def tokens_of(spark: SparkSession, text: str) -> list[str]:
    """Tokens of one query text, by the same expression that indexes the documents."""
    return spark.sql("SELECT :text AS text", args={"text": text}).select(tokenize(F.col("text"))).first()[0]
