"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ten consecutive words of an item (or all words of a shorter item). It occurs in a
document only where all its shingles do, so one shingle is a sufficient prefix: the rarest, by
occurrences counted over all documents. One pass over the documents stores the places of shingles whose
bit is set in a bitmap of fixed size; both the counts and the search for the prefix shingles read these. The
places join the windows' prefix shingles, the position of the shingle in its window fixes where the
window would begin, windows that would not fit are dropped, and the words decide.

Defined results: null and empty texts have no words and no hits; documents and items are compared
whole; repeated documents are rows of their own; repeated items with one id count once; an item
without an id marks words but is not listed; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.bitmap import bitmap, is_set
from cratewise.llm.columns import spare
from cratewise.session import materialize

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Bits of the filter that documents' shingles pass; more items only make it less selective.
FILTER_BITS = 1 << 20
#: Prefix rows up to this many are broadcast (about 400 bytes each); beyond it the join is shuffled and salted.
BROADCAST_ROWS = 100_000
SALTS = 64


def words(text: Column) -> Column:
    """The lower-cased words of a text; A-Z only are lower-cased. Splitting costs a fraction of extracting every match."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BETWEEN), "")  # empty before a first and after a last separator


def item_windows(items: DataFrame) -> DataFrame:
    """``(item_id, window, w)``: the distinct windows of every item."""
    listed = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    return listed.select(
        "item_id", size.alias("w"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"), "words"
    ).select("item_id", F.slice("words", F.col("at"), F.col("w")).alias("window"), "w").distinct()


def _shingles(array: Column, length: Column | int) -> Column:
    """Hashes of all runs of ``length`` words, in order; none if there are fewer words."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.size(array) >= length, F.sequence(F.lit(1), F.size(array) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(array, i, length)))


def decontaminate(docs: DataFrame, items: DataFrame, bits: int = FILTER_BITS, broadcast_rows: int = BROADCAST_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; ``keep`` names
    further columns of ``docs`` to carry along.
    """
    windows = materialize(item_windows(items), "windows").df
    length = F.least("w", F.lit(SHINGLE))
    shingles = windows.select("item_id", "window", "w", length.alias("l"), F.posexplode(_shingles(F.col("window"), length)).alias("off", "hash"))
    lengths = sorted(r["l"] for r in windows.select(length.alias("l")).distinct().collect())  # SHINGLE values at most
    listed = bitmap(shingles, bits)
    text = docs.select("doc_id", *keep, "text", words(F.col("text")).alias("words"))
    places = F.concat(F.array().cast(_PLACES), *[_places(n, listed, bits) for n in lengths])
    placed = text.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *keep, F.size("words").cast("bigint").alias("n_words"), places.alias("found"), "text")
    # the only pass over all texts; those without a listed shingle are not needed again
    stored = materialize(placed.withColumn("text", F.when(F.size("found") > 0, F.col("text"))), "places").df

    often = stored.select(F.explode("found.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    ranked = shingles.join(often, "hash", "left")
    # a shingle that no document has rules its window out: it stays first and is dropped
    rarest = ranked.groupBy("item_id", "window", "w", "l").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "off", "hash")).alias("p"))
    prefix = materialize(rarest.where("p.often > 0").select("item_id", "window", "w", "l", F.col("p.off").alias("off"), F.col("p.hash").alias("hash")), "prefix")

    needed = bitmap(prefix.df, bits)
    asked = stored.withColumn("found", F.filter("found", lambda x: is_set(needed, x["hash"], bits)))
    asked = asked.withColumn("words", F.when(F.size("found") > 0, words(F.col("text")))).drop("text")
    # named twice, so that the words are one column and not taken from the text for every place
    around = F.when(F.size("words") > 0, F.transform("found", _with_words))
    spread = F.when(F.size("found") > 0, F.pmod("rid", F.lit(SALTS))).otherwise(F.pmod(F.xxhash64("rid"), F.lit(SALTS))).cast("int")
    found = (
        asked.select("rid", "doc_id", *keep, "n_words", spread.alias("salt"), F.explode_outer(around).alias("f"))
        .select("rid", "doc_id", *keep, "n_words", "salt", "f.*")
    )
    if prefix.rows <= broadcast_rows:
        joined = found.join(F.broadcast(prefix.df), ["hash", "l"], "left")
    else:
        copies = prefix.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.join(copies, ["hash", "l", "salt"], "left")
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("w") <= F.col("n_words"))
    same = F.slice("near", (start - F.col("first") + 1).cast("int"), F.col("w")) == F.col("window")
    # one branch decides in order: the position first, then the words
    hit = F.when(F.col("window").isNotNull() & fits, same).otherwise(False)
    per_doc = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.max(c).alias(c) for c in keep],
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct(start.alias("s"), F.col("w").alias("w")))).alias("spans"),
        F.collect_set(F.when(hit, F.col("item_id").cast("string"))).alias("items"),
    )
    hits = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["w"] - 1)))))
    return per_doc.select(
        "doc_id",
        "n_words",
        hits.cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
        *keep,
    )


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns."""
    (uid,) = spare(docs, "_uid")
    # rows equal in both have the same verdict; nulls leave no trace in a hash
    marked = docs.withColumn(uid, F.xxhash64("doc_id", F.isnull("doc_id"), "text"))
    found = decontaminate(marked, items, keep=(uid,)).where("contaminated").select(uid).distinct()
    return marked.join(found, uid, "left_anti").select(*docs.columns)


_PLACES = "array<struct<hash:bigint,l:int,pos:int>>"


def _places(n: int, cells: Column, bits: int) -> Column:
    """Where the text has a shingle of ``n`` words that an item may have."""
    hashed = F.transform(
        _shingles(F.col("words"), n),
        lambda h, i: F.when(is_set(cells, h, bits), F.struct(h.alias("hash"), F.lit(n).alias("l"), i.alias("pos"))),
    )
    return F.filter(hashed, lambda x: x.isNotNull())


def _with_words(place: Column) -> Column:
    """The place with the words around it, from word ``first`` on."""
    first = F.greatest(place["pos"] - (WINDOW - 1), F.lit(0))
    near = F.slice(F.col("words"), first + 1, F.lit(2 * WINDOW))
    return F.struct(place["hash"].alias("hash"), place["l"].alias("l"), place["pos"].alias("pos"), first.alias("first"), near.alias("near"))
