"""Personal data and the terms that give it away, in DataFrame functions only.

Identifiers (addresses, numbers) are found by pattern. The protected entities are their values and the parts
by which values recur: an address's name and its domain, the network of an IP, a card's issuer digits, a
phone's digits before the last seven. A term in a text with an entity reveals it as far as the corpus says
so: its pointwise mutual information with the entity, as a share of the entity's own information content, is
the disclosure. At ``REMOVE`` and above the term is removed, at ``GENERALISE`` and above it is generalised to
its word shape. Terms are words of any length, counted over whole texts and marked wherever they stand in a
text that holds the entity. Documents are counted by distinct text, so copies of a text are no evidence.
A term needs ``SUPPORT`` texts with the entity, and they must be more than chance: texts times information
reach ``EVIDENCE`` times the logarithm of the number of texts, which random meetings with a common domain do not.

Defined results: null and empty texts have no spans; whole texts are searched, however long; repeated
rows are rows of their own; terms are only marked in texts with their entity, never in other documents,
and never inside an identifier; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.bitmap import bitmap, is_set
from cratewise.llm.columns import spare
from cratewise.operators.skew import even_join
from cratewise.session import materialize

#: The kinds in their order. The patterns match what the plain ones would, without backtracking: possessive
#: loops need no stack, and a run is tried at its start or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
SIGNS = {"email": "@", "ip": "[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
KINDS = [*PATTERNS, "term", "general"]
TERM = r"\p{L}++"
SUPPORT = 2
EVIDENCE = 1.5
REMOVE, GENERALISE = 0.95, 0.8
#: Bits of the filters for terms and for copied texts; fuller filters let more rows through, none are lost.
FILTER_BITS, COPY_BITS = 1 << 20, 1 << 22
REPLACEMENT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REMOVED]"}


def luhn(digits: Column) -> Column:
    """Whether the last digit of a number is its check digit."""

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((F.length(digits) - i) % 2 == 1, 2 * d).otherwise(d)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(9, 15)
    return F.lit(True)


_FOUND = "array<struct<kind:int,nth:int,gap:int,len:int,ok:boolean,entities:array<bigint>>>"
_MARKS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _entities(kind: str, match: Column) -> Column:
    """Hashes of a value and of the parts that other values may share with it."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = {
        "email": [F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)],
        "ip": [F.substring_index(match, ".", 3)],
        "card": [F.substring(digits, 1, 6)],
        "phone": [F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 7, F.lit(0)))],
    }
    return F.array(F.xxhash64(F.lit(kind), match), *[F.xxhash64(F.lit(kind), F.lit(i), p) for i, p in enumerate(parts[kind])])


def _found(kind: str) -> Column:
    """All matches of a kind with their distance from the match before."""
    text, pattern = F.col("text"), PATTERNS[kind]
    around = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("nth"),
            F.length(x["1"]).alias("gap"),
            F.length(x["0"]).alias("len"),
            _valid(kind, x["0"]).alias("ok"),
            _entities(kind, x["0"]).alias("entities"),
        )

    found = F.transform(F.filter(around, lambda x: x["0"].isNotNull()), one)
    return F.when(text.rlike(SIGNS[kind]), found.cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def find(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, uid, spans)`` per row of ``docs`` (``doc_id``, ``text``): ``uid`` is a hash of both, ``spans``
    are ``(start, kind, end)`` in order, ``kind`` a place in ``KINDS``, in code points with exclusive ends."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = materialize(
        texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.xxhash64("text").alias("text_id"), F.concat(*map(_found, PATTERNS)).alias("found")), "found"
    ).df
    matches = facts.select("rid", "text_id", F.explode("found").alias("f")).select("rid", "text_id", "f.*")
    order = Window.partitionBy("rid", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    base = materialize(matches.withColumn("end", end).where("ok").withColumn("start", F.col("end") - F.col("len")).drop("nth", "gap", "len", "ok"), "base").df

    own = base.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("firm"))
    marked = _marked(facts, base, texts, bits)
    result = facts.select("rid", "doc_id", "uid").join(own, "rid", "left")
    firm, terms = F.coalesce("firm", F.array().cast(_MARKS)), F.array().cast(_MARKS)
    if marked is not None:
        result = result.join(even_join(facts.select("rid", "text_id"), marked, "text_id").select("rid", "marks"), "rid", "left")
        terms = F.coalesce("marks", terms)
    clear = F.filter(terms, lambda x: ~F.exists(firm, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return result.select("doc_id", "uid", F.sort_array(F.concat(firm, clear)).alias("spans"))


def _marked(facts: DataFrame, base: DataFrame, texts: DataFrame, bits: int) -> DataFrame | None:
    """``(text_id, marks)``: every place of a disclosing term, by text; none if no entity has the support."""
    held = materialize(base.select(F.explode("entities").alias("entity"), "text_id").distinct(), "named").df
    recurring = held.groupBy("entity").agg(F.count(F.lit(1)).alias("has_entity")).where(F.col("has_entity") >= SUPPORT)
    held = materialize(even_join(held, recurring, "entity"), "held")
    if not held.rows:
        return None
    holders = texts.withColumn("text_id", F.xxhash64("text")).select("text_id", "text")
    asked = lambda some: holders.where(is_set(bitmap(some.select(F.col("text_id").alias("hash")), COPY_BITS), F.col("text_id"), COPY_BITS))
    used = asked(held.df).select("text_id", F.explode(_words(F.col("text"))).alias("term")).distinct()
    risky = _disclosing(facts, held.df, used, texts, bits)
    kinds = materialize(held.df.join(risky, "entity").groupBy("text_id", "term").agg(F.min("kind").alias("kind")), "risky")
    if not kinds.rows:
        return None
    lists = kinds.df.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("risky"))
    return asked(kinds.df).dropDuplicates(["text_id"]).join(lists, "text_id").select("text_id", _places(F.col("text"), F.col("risky")).alias("marks"))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _places(text: Column, risky: Column) -> Column:
    """Where the terms of the map ``risky`` stand in a text, with their kinds."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_MARKS).alias("marks"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["1"])
        end = start + F.length(x["0"])
        kind = F.try_element_at(risky, F.lower(x["0"]))
        mark = F.array(F.struct(start.alias("start"), kind.alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kind.isNull(), done["marks"]).otherwise(F.concat(done["marks"], mark)).alias("marks"))

    return F.aggregate(F.filter(pieces, lambda x: x["0"].isNotNull()), nothing, step)["marks"].cast(_MARKS)


def _disclosing(facts: DataFrame, held: DataFrame, used: DataFrame, texts: DataFrame, bits: int) -> DataFrame:
    """``(entity, term, kind)``: the terms that reveal an entity, and what becomes of them."""
    n = float(facts.select("text_id").distinct().count())
    content = F.log(n / F.col("has_entity"))
    together = held.join(used, "text_id").groupBy("entity", "has_entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT)
    # no term says more about an entity than its whole content
    pairs = materialize(together.where(F.col("both") * content >= EVIDENCE * math.log(n)), "pairs").df
    asked = bitmap(pairs.select(F.xxhash64("term").alias("hash")), bits)
    everywhere = texts.select(F.xxhash64("text").alias("text_id"), F.explode(F.filter(_words(F.col("text")), lambda w: is_set(asked, F.xxhash64(w), bits))).alias("term"))
    # texts that occur once are counted before the shuffle; only those that may be copies travel by name
    copies = facts.groupBy("text_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("text_id").alias("hash"))
    copied = F.when(is_set(bitmap(copies, COPY_BITS), F.col("text_id"), COPY_BITS), F.col("text_id")).alias("copied")
    counted = everywhere.groupBy("term", copied).agg(F.count(F.lit(1)).alias("c"))
    with_term = counted.groupBy("term").agg(F.sum(F.when(F.col("copied").isNull(), F.col("c")).otherwise(1)).alias("has_term"))
    information = F.log(F.col("both") * n / (F.col("has_entity") * F.col("has_term")))
    told = pairs.join(with_term, "term").where((content > 0) & (F.col("both") * information >= EVIDENCE * math.log(n)))
    judged = told.withColumn("share", information / content)
    kind = F.when(F.col("share") >= REMOVE, KINDS.index("term")).otherwise(KINDS.index("general"))
    return judged.where(F.col("share") >= GENERALISE).select("entity", "term", kind.alias("kind"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of each kind of identifier, a digest of them, and all spans as text, per row of ``find``."""
    base = F.filter("spans", lambda x: x["kind"] < len(PATTERNS))
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mark of its kind, a generalised term by its shape
    (``[Xx]`` for a capitalised word); of overlapping spans the first counts."""
    spans = find(docs).select("uid", "spans").where(F.size("spans") > 0).dropDuplicates(["uid"])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    marks = F.array(*[F.lit(mark) for mark in REPLACEMENT.values()])  # in the order of KINDS

    def step(done: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        word = F.substring(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(word, r"[\p{L}&&[^\p{Lu}]]+", "x"), r"\p{Lu}+", "X")
        mark = F.coalesce(F.get(marks, x["kind"]), F.concat(F.lit("["), shape, F.lit("]")))
        new = F.struct(x["end"].alias("at"), F.concat(done["parts"], F.array(before, mark)).alias("parts"))
        return F.when(x["start"] >= done["at"], new).otherwise(done)

    def text(spans: str) -> Column:
        done = F.aggregate(spans, start, step)
        rest = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))
        return F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(done["parts"], ""), rest))

    uid, own = spare(docs, "_uid", "_spans")
    marked = docs.withColumn(uid, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(spans.withColumnsRenamed({"uid": uid, "spans": own}), uid, "left")
    return marked.withColumn("text", text(own)).select(*docs.columns)
