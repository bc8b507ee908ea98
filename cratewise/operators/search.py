"""Full-text search over an inverted index: matching, BM25 ranking, filters, pages, request batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratewise.functions.present import DEFAULT_LIMIT, DEFAULT_OFFSET
from cratewise.functions.text import tokenize, tokens_of
from cratewise.operators.sequence import number_rows
from cratewise.session import materialize

# The BM25 constants and the floor of the inverse document frequency.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

CATALOG_COLUMNS = ["package_id", "package_name", "attribute_path", "description", "long_description", "main_program"]
STORE_COLUMNS = ["id", "name", "description"]
RANK_SALTS = 256
# Searches read no deeper than this are cut to their best rows before the shuffle.
SHALLOW = 500
# Searches read deeper than this are ranked by a distributed sort instead of a window.
DEEP = 100_000
# Documents of a block of postings, and the postings from which a search looks at the blocks' maxima first.
BLOCK_DOCS = 4096
SKIP_FROM = 4_000_000
# Pages that end deeper than this are cut out by their scores instead of kept as a top list; so many bins, so many rows to sort.
TOP_LIST = 10_000
SCORE_BINS = 1 << 12
# Parts of a frequent term's documents in a batch, and the characters by which prefixes and terms meet.
TERM_SALTS = 8
LEAD = 3
# Tokens that a task groups at once; one longer text is still grouped whole.
TOKENS_AT_ONCE = 1 << 18
POSTINGS = "term string, doc_id string, col string, tf bigint, positions array<int>"


@dataclass
class SearchIndex:
    """``postings(term, doc_id, col, tf, positions)``, ``docs(doc_id, dl, ...)`` and ``corpus(n, avgdl)``.

    A written index also has a dictionary ``terms(term, df, cf)`` and ``blocks(term, block, n, best, entries)``: the
    documents of a term with their saturation, in blocks that are the same for all terms, and the largest of each block.
    """

    postings: DataFrame
    docs: DataFrame
    corpus: DataFrame
    terms: DataFrame | None = None
    blocks: DataFrame | None = None


@dataclass(frozen=True)
class Unit:
    """One thing to look for: a token, or several adjacent ones; the last may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass
class Query:
    """All of ``required``, at least one of ``any_of`` if given, none of ``excluded``."""

    required: list[Unit] = field(default_factory=list)
    any_of: list[Unit] = field(default_factory=list)
    excluded: list[Unit] = field(default_factory=list)


def build_index(documents: DataFrame, id_column: str, columns: list[str], keep: list[str] | None = None) -> SearchIndex:
    """Index ``columns`` of one row per document; ``keep`` columns stay with the documents for filters.

    The tokens of a text are in one row, so its postings are made there: nothing is shuffled, and no row is a token.
    """
    doc_id = F.col(id_column).cast("string").alias("doc_id")
    texts = F.array(
        *[F.struct(F.lit(c).alias("col"), tokenize(F.col(c).cast("string")).alias("tokens")) for c in columns]
    )
    tokens = documents.select(doc_id, F.explode(texts).alias("t")).select("doc_id", "t.col", "t.tokens")
    postings = tokens.mapInArrow(_inverted, POSTINGS)
    length = sum((F.size(tokenize(F.col(c).cast("string"))) for c in columns[1:]), F.size(tokenize(F.col(columns[0]).cast("string"))))
    docs = documents.select(doc_id, length.cast("bigint").alias("dl"), *(keep or []))
    return SearchIndex(postings, docs, corpus_of(docs))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows ``(doc_id, col, tokens)``, for some rows at a time."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(ends):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + TOKENS_AT_ONCE, side="right")))
            yield _postings_of(batch.slice(begin, end - begin))
            begin = end


def _postings_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    size = pc.list_value_length(rows.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = rows.column("tokens").flatten().dictionary_encode()
    row = np.repeat(np.arange(len(size)), size)
    position = (np.arange(len(row)) - (np.cumsum(size) - size)[row]).astype(np.int32)
    # the rows of a term follow each other, which shuffles and files compress well
    key = coded.indices.to_numpy().astype(np.int64) * len(size) + row
    order = np.argsort(key, kind="stable")  # the positions of a term stay in order
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(first, len(order))
    one = pa.array(order[first])
    whose = pa.array(row[order[first]])
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(coded.indices.take(one)),
            rows.column("doc_id").take(whose),
            rows.column("col").take(whose),
            pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order])),
        ],
        ["term", "doc_id", "col", "tf", "positions"],
    )


def corpus_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def write_index(index: SearchIndex, path: str) -> None:
    """Postings in (term, doc_id) order: a term reads a few row groups, and a term that is in
    every document still spreads over many files. Beside them the dictionary and the blocks.

    The postings are first stored as the texts come: the bounds of ranges are sampled from them, and a document's
    rows lie together, so its length is summed before the shuffle."""
    spark = index.docs.sparkSession
    stored = materialize(index.postings, "postings")
    postings = stored.df
    (
        postings.repartitionByRange("term", "doc_id")
        .sortWithinPartitions("term", "doc_id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#term", "true")
        .parquet(f"{path}/postings")
    )
    # lengths are in the postings already; taking them from the texts would tokenize these again
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("sum"))
    own = index.docs.drop("dl").join(lengths, "doc_id", "left").withColumn("dl", F.coalesce("sum", F.lit(0))).select(*index.docs.columns)
    own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    corpus_of(docs).write.mode("overwrite").parquet(f"{path}/corpus")
    blocks_of(postings, docs).sortWithinPartitions("term", "block").write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#term", "true"
    ).parquet(f"{path}/blocks")
    stored.drop()
    counts = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def blocks_of(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, block, n, cf, best, entries)``: the documents of a term with their saturation.

    Documents of similar length share a block, for all terms the same ones, so the largest
    saturations of blocks differ, and a block can be ruled out for a whole query.
    """
    placed = number_rows(docs.select("doc_id", "dl"), ["dl", "doc_id"], "nth")
    average = docs.agg(F.avg("dl")).first()[0] or 1.0
    block = F.floor((F.col("nth") - 1) / BLOCK_DOCS)
    rows = postings.select("term", "doc_id", "tf").join(placed.select("doc_id", "dl", block.alias("block")), "doc_id")
    # both aggregations below and the files that are written go by this one shuffle
    per_doc = rows.repartitionByRange("term", "block").groupBy("term", "block", "doc_id", "dl").agg(F.sum("tf").alias("f"))
    weight = saturation(F.col("f"), F.col("dl"), F.lit(average))
    return (
        per_doc.select("term", "block", "f", F.struct("doc_id", weight.alias("weight")).alias("e"))
        .groupBy("term", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("cf"), F.max("e.weight").alias("best"), F.sort_array(F.collect_list("e")).alias("entries"))
    )


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    docs = spark.read.parquet(f"{path}/docs")  # its columns are the caller's

    def part(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return SearchIndex(
        part("postings", POSTINGS),
        docs,
        part("corpus", "n bigint, avgdl double"),
        part("terms", "term string, df bigint, cf bigint"),
        part("blocks", "term string, block bigint, n bigint, cf bigint, best double, entries array<struct<doc_id: string, weight: double>>"),
    )


def term_stats(index: SearchIndex) -> DataFrame:
    """``(term, df, cf)``: documents with the term, and its occurrences."""
    if index.terms is not None:
        return index.terms.select("term", "df", "cf")
    per_doc = index.postings.groupBy("term", "doc_id").agg(F.sum("tf").alias("f"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("cf"))


# --- one query --------------------------------------------------------------------------------


def units_of(spark: SparkSession, text: str, column: str | None = None) -> list[Unit]:
    """Units of a query text: quoted parts are phrases, everything else single tokens."""
    units: list[Unit] = []
    if not text.strip():
        return units
    for i, part in enumerate(text.split('"')):
        tokens = tokens_of(spark, part)
        if i % 2 and tokens:
            units.append(Unit(tuple(tokens), column=column))
        elif not i % 2:
            units += [Unit((t,), column=column) for t in tokens]
    return list(dict.fromkeys(units))


def make_query(
    spark: SparkSession,
    q: str = "",
    any_of: str = "",
    none_of: str = "",
    prefix: str = "",
    in_columns: dict[str, str] | None = None,
) -> Query:
    """A query from plain texts; ``prefix`` tokens match by their beginning, ``in_columns`` within one column."""
    required = units_of(spark, q)
    required += [Unit((t,), prefix=True) for t in (tokens_of(spark, prefix) if prefix.strip() else [])]
    for column, text in (in_columns or {}).items():
        required += units_of(spark, text, column)
    return Query(required, units_of(spark, any_of), units_of(spark, none_of))


def _is_token(unit: Unit, position: int) -> Column:
    token, last = unit.tokens[position], position == len(unit.tokens) - 1
    test = F.col("term").startswith(token) if unit.prefix and last else F.col("term") == token
    return test if unit.column is None else test & (F.col("col") == unit.column)


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def unit_frequencies(index: SearchIndex, units: list[Unit]) -> DataFrame:
    """``(doc_id, f0, f1, ...)``: how often each unit occurs in each document that has any of them.

    Exact tokens reach the scan of the postings as one ``term IN (...)`` filter. Phrases
    need the positions of one column of one document at a time.
    """
    exact = sorted({t for u in units for i, t in enumerate(u.tokens) if not (u.prefix and i == len(u.tokens) - 1)})
    wanted = F.col("term").isin(exact) if exact else F.lit(False)
    for unit in units:
        if unit.prefix:
            wanted = wanted | F.col("term").startswith(unit.tokens[-1])
    rows = index.postings.where(wanted)
    if all(len(u.tokens) == 1 for u in units):
        sums = [F.sum(F.when(_is_token(u, 0), F.col("tf")).otherwise(0)).alias(f"f{i}") for i, u in enumerate(units)]
        return rows.groupBy("doc_id").agg(*sums)
    # Where phrases are asked, first one row per document and column, then one per document.
    parts, counts = [], []
    for i, unit in enumerate(units):
        if len(unit.tokens) == 1:
            parts.append(F.sum(F.when(_is_token(unit, 0), F.col("tf")).otherwise(0)).alias(f"c{i}"))
            counts.append(F.col(f"c{i}"))
            continue
        starts = []
        for j in range(len(unit.tokens)):
            at = F.flatten(F.collect_list(F.when(_is_token(unit, j), F.col("positions"))))
            parts.append(at.alias(f"p{i}_{j}"))
            starts.append(_shifted(f"p{i}_{j}", j))
        both = starts[0]
        for other in starts[1:]:
            both = F.array_intersect(both, other)
        counts.append(F.size(both))
    per_column = rows.groupBy("doc_id", "col").agg(*parts)
    return per_column.groupBy("doc_id").agg(*[F.sum(c).alias(f"f{i}") for i, c in enumerate(counts)])


def idf(n_docs: Column, with_unit: Column) -> Column:
    raw = F.log((n_docs - with_unit + 0.5) / (with_unit + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def saturation(frequency: Column, length: Column, average: Column) -> Column:
    return frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / average))


def matches(index: SearchIndex, query: Query, allowed: DataFrame | None = None) -> DataFrame:
    """``(doc_id, score)`` of all documents that satisfy the query, before paging.

    ``allowed`` is ``index.docs`` after filters; corpus and document frequencies always
    come from the whole index.
    """
    docs = index.docs if allowed is None else allowed
    scored = query.required + query.any_of
    if not scored:
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    if by_blocks(index, query):
        return block_matches(index, query, None if docs is index.docs else docs, dictionary(index, query))
    units = scored + query.excluded
    # Read twice below, and small next to the postings.
    freq = materialize(unit_frequencies(index, units), "frequencies").df
    test = _satisfies(query, [F.col(f"f{i}") for i in range(len(units))])
    counts = [F.count_if(F.col(f"f{i}") > 0) for i in range(len(scored))]
    stats = freq.agg(F.array(*counts).alias("found")).crossJoin(index.corpus).first()  # a row each
    score = F.lit(0.0)
    for i in range(len(scored)):
        weight = idf(F.lit(stats["n"]), F.lit(stats["found"][i]))
        score = score + weight * saturation(F.col(f"f{i}"), F.col("dl"), F.lit(stats["avgdl"]))
    return freq.where(test).join(docs, "doc_id").select("doc_id", score.alias("score"))


def _satisfies(query: Query, found: list[Column]) -> Column:
    """Whether the occurrences of the units, in their order, are what the query asks for."""
    have, rest = found[: len(query.required)], found[len(query.required) :]
    either, without = rest[: len(query.any_of)], rest[len(query.any_of) :]
    test = F.lit(True)
    for f in have:
        test = test & (f > 0)
    if either:
        test = test & (F.greatest(*either, F.lit(0)) > 0)
    for f in without:
        test = test & (f == 0)
    return test


# Single tokens are answered by blocks: their counts are in the dictionary, their saturations are stored.


def by_blocks(index: SearchIndex, query: Query) -> bool:
    units = query.required + query.any_of + query.excluded
    return index.blocks is not None and all(len(u.tokens) == 1 and not u.prefix and u.column is None for u in units)


def dictionary(index: SearchIndex, query: Query) -> dict[str | None, int]:
    """Documents with each token of the query and, under None, all documents; one small job."""
    tokens = [u.tokens[0] for u in query.required + query.any_of]
    counts = index.terms.where(F.col("term").isin(tokens)).select("term", "df")
    rows = counts.unionByName(index.corpus.select(F.lit(None).cast("string").alias("term"), F.col("n").alias("df"))).collect()
    return {t: 0 for t in tokens} | {r["term"]: r["df"] for r in rows}


def _idf_of(counts: dict[str | None, int], unit: Unit) -> Column:
    return idf(F.lit(counts[None]), F.lit(counts[unit.tokens[0]]))


def block_matches(
    index: SearchIndex, query: Query, allowed: DataFrame | None, counts: dict[str | None, int], blocks: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, score)`` of the matches, from ``blocks(block)`` alone where these are given."""
    units = query.required + query.any_of + query.excluded
    rows = index.blocks.where(F.col("term").isin([u.tokens[0] for u in units]))
    if blocks is not None:
        rows = rows.join(blocks, "block", "left_semi")
    entries = rows.select("term", F.explode("entries").alias("e")).select("term", "e.doc_id", "e.weight")
    if len(units) == 1:
        hits = entries.select("doc_id", (_idf_of(counts, units[0]) * F.col("weight")).alias("score"))
    else:
        weights = [F.max(F.when(F.col("term") == u.tokens[0], F.col("weight")).otherwise(0.0)).alias(f"w{i}") for i, u in enumerate(units)]
        score = F.lit(0.0)
        for i, unit in enumerate(query.required + query.any_of):
            score = score + _idf_of(counts, unit) * F.col(f"w{i}")
        found = entries.groupBy("doc_id").agg(*weights)
        hits = found.where(_satisfies(query, [F.col(f"w{i}") for i in range(len(units))])).select("doc_id", score.alias("score"))
    return hits if allowed is None else hits.join(allowed.select("doc_id"), "doc_id", "left_semi")


def promising_blocks(
    index: SearchIndex, query: Query, allowed: DataFrame | None, counts: dict[str | None, int], rows: int
) -> DataFrame:
    """``(block)``: all blocks that can hold one of the best ``rows`` matches.

    A block's bound is the sum of its largest scores by unit. The blocks with the highest bounds are searched first; the
    score of the last row of a page found in them is one that the whole page reaches, so blocks bounded below it are left out.
    """
    scored = query.required + query.any_of
    tokens = [u.tokens[0] for u in scored]
    bests = [F.max(F.when(F.col("term") == t, F.col("best")).otherwise(0.0)).alias(f"b{i}") for i, t in enumerate(tokens)]
    bound = F.lit(0.0)
    for i, unit in enumerate(scored):
        bound = bound + _idf_of(counts, unit) * F.col(f"b{i}")
    there = index.blocks.where(F.col("term").isin(tokens)).groupBy("block").agg(*bests)
    with_all = _satisfies(Query(query.required, query.any_of), [F.col(f"b{i}") for i in range(len(scored))])
    bounds = materialize(there.where(with_all).select("block", bound.alias("bound")), "bounds").df
    first = bounds.orderBy(F.desc("bound"), "block").limit(max(8, -(-2 * rows // BLOCK_DOCS))).select("block")
    best = block_matches(index, query, allowed, counts, first).orderBy(F.desc("score"), "doc_id").limit(rows)
    row = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    reached = row["least"] if row["n"] == rows else 0.0
    return bounds.where(F.col("bound") >= reached * (1 - 1e-12)).select("block")


def filter_docs(
    docs: DataFrame,
    category: str | None = None,
    include_broken: bool = False,
    include_unfree: bool = False,
    license: str | None = None,
    doc_licenses: DataFrame | None = None,
) -> DataFrame:
    """Documents that pass the filters; ``doc_licenses(doc_id, short_name)`` serves the license filter."""
    if not include_broken and "broken" in docs.columns:
        docs = docs.where(~F.col("broken"))
    if not include_unfree and "unfree" in docs.columns:
        docs = docs.where(~F.col("unfree"))
    if category:
        docs = docs.where(F.col("category") == category)
    if license:
        if doc_licenses is None:
            raise ValueError("a license filter needs doc_licenses")
        having = doc_licenses.where(F.lower("short_name") == license.lower())
        docs = docs.join(having.select("doc_id"), "doc_id", "left_semi")
    return docs


def page(hits: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = DEFAULT_OFFSET, top_list: int = TOP_LIST) -> DataFrame:
    """The hits from ``offset`` on, best first, ties by id; a negative limit means all of them.

    A page near the top is a top list. A deeper one is cut out by its first and last row, which histograms of the
    scores find, and only its own rows are sorted, in ranges.
    """
    offset = max(offset, 0)
    best = [F.desc("score"), F.col("doc_id")]
    if limit < 0 and offset == 0:
        return hits.orderBy(*best)
    if 0 <= limit and offset + limit <= top_list:
        return hits.orderBy(*best).offset(offset).limit(limit)
    stored = materialize(hits, "hits")
    end = stored.rows if limit < 0 else min(stored.rows, offset + limit)
    if offset >= end:
        return stored.df.limit(0)
    band = stored.df
    if offset > 0:
        band = band.where(~_before(row_at(stored.df, offset, top_list)))
    if end < stored.rows:
        band = band.where(_before(row_at(stored.df, end, top_list)))
    return band.orderBy(*best)


def _before(row: tuple[float, str]) -> Column:
    return (F.col("score") > row[0]) | ((F.col("score") == row[0]) & (F.col("doc_id") < row[1]))


def row_at(hits: DataFrame, rank: int, few: int = TOP_LIST) -> tuple[float, str]:
    """Score and id of the row with so many rows before it, for stored hits.

    Histograms narrow the scores down to a bin of ``few`` rows, or to one score that many rows share; rows
    of one score are numbered by id in ranges.
    """
    while True:
        ends = hits.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n")).first()
        low, high = ends["low"], ends["high"]
        if ends["n"] <= few:
            row = hits.orderBy(F.desc("score"), "doc_id").offset(rank).limit(1).first()
            return row["score"], row["doc_id"]
        if low == high:
            row = number_rows(hits, ["doc_id"], "nth").where(F.col("nth") == rank + 1).first()
            return row["score"], row["doc_id"]
        bin_ = F.least(F.floor((F.lit(high) - F.col("score")) / F.lit(high - low) * SCORE_BINS), F.lit(SCORE_BINS - 1))
        counts = hits.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
        for found in sorted(counts.collect(), key=lambda r: r["bin"]):
            if rank < found["n"]:
                break
            rank -= found["n"]
        hits = hits.where(F.col("score").between(found["least"], found["most"]))


def search(
    index: SearchIndex,
    q: str = "",
    limit: int = DEFAULT_LIMIT,
    offset: int = DEFAULT_OFFSET,
    store: DataFrame | None = None,
    license: str | None = None,
    category: str | None = None,
    include_broken: bool = False,
    include_unfree: bool = False,
    doc_licenses: DataFrame | None = None,
    query: Query | None = None,
    skip_from: int = SKIP_FROM,
) -> DataFrame:
    """One page of ``(doc_id, score, total_count)``, with the stored ``doc`` if a store is given.

    Ranks on the slim index first and fetches documents only for the page. The total
    counts all matches after filters and before paging.
    """
    query = query or make_query(index.docs.sparkSession, q)
    allowed = filter_docs(index.docs, category, include_broken, include_unfree, license, doc_licenses)
    if query.required + query.any_of and by_blocks(index, query):
        hits, shown, total = _search_blocks(index, query, None if allowed is index.docs else allowed, limit, offset, skip_from)
    else:
        hits = shown = matches(index, query, allowed)
        total = None
    if total is None:
        total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = page(shown, limit, offset).withColumn("total_count", total)
    if store is None:
        return shown
    wanted = store.join(shown.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return shown.join(wanted.select(F.col("id").alias("doc_id"), "doc"), "doc_id", "left")


def _search_blocks(
    index: SearchIndex, query: Query, allowed: DataFrame | None, limit: int, offset: int, skip_from: int
) -> tuple[DataFrame, DataFrame, Column | None]:
    """All matches, those that the page is taken from, and their number where the dictionary has it."""
    counts = dictionary(index, query)
    hits = block_matches(index, query, allowed, counts)
    only = query.required[0] if len(query.required) == 1 and not query.any_of and not query.excluded else None
    total = F.lit(counts[only.tokens[0]]).cast("bigint") if only and allowed is None else None
    depth = max(offset, 0) + limit
    if limit < 0 or depth > TOP_LIST or sum(counts[u.tokens[0]] for u in query.required + query.any_of) < skip_from:
        return hits, hits, total
    some = promising_blocks(index, query, allowed, counts, max(depth, 1))
    return hits, block_matches(index, query, allowed, counts, some), total


# --- many queries -----------------------------------------------------------------------------


def request_units(requests: DataFrame, key: str) -> DataFrame:
    """``(key, unit, pos, term, size)``: the distinct units of each request text ``q``."""
    parts = requests.select(key, F.posexplode(F.split("q", '"')).alias("part", "text"))
    tokens = parts.select(key, (F.col("part") % 2 == 1).alias("quoted"), tokenize(F.col("text")).alias("tokens"))
    units = F.when(F.col("quoted"), F.array("tokens")).otherwise(F.transform("tokens", lambda t: F.array(t)))
    each = tokens.select(key, F.explode(units).alias("unit")).where(F.size("unit") > 0).distinct()
    return each.select(key, "unit", F.size("unit").alias("size"), F.posexplode("unit").alias("pos", "term"))


def prefix_terms(dictionary_terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(prefix, term)`` for distinct ``prefixes(prefix)``: a range join on leading characters.

    Both sides meet by up to ``LEAD`` first characters; only terms of an equal lead are compared further.
    """
    size = F.least(F.length("prefix"), F.lit(LEAD))
    asked = prefixes.select("prefix", size.alias("size"), F.left("prefix", size).alias("lead"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(LEAD)))).alias("size")
    terms = dictionary_terms.select("term", sizes).select("term", "size", F.left("term", F.col("size")).alias("lead"))
    return asked.join(terms, ["size", "lead"]).where(F.startswith("term", "prefix")).select("prefix", "term")


# How a search uses a unit; the numbers are tags of its rows.
REQUIRED, ANY_OF, NONE_OF = range(3)


def tagged_units(index: SearchIndex, asks: DataFrame) -> DataFrame:
    """``(ask, tag, unit, size, pos, term)``: all units of the asked texts; a prefix has a row per term that it begins."""

    def plain(column: str, tag: int) -> DataFrame:
        units = request_units(asks.select("ask", F.coalesce(column, F.lit("")).alias("q")), "ask")
        return units.select("ask", F.lit(tag).alias("tag"), F.concat(F.lit("t:"), F.array_join("unit", " ")).alias("unit"), "size", "pos", "term")

    rows = plain("q", REQUIRED)
    for column, tag in (("any_of", ANY_OF), ("none_of", NONE_OF)):
        if column in asks.columns:
            rows = rows.unionByName(plain(column, tag))
    if "prefix" in asks.columns:
        begun = asks.select("ask", F.explode(tokenize(F.coalesce("prefix", F.lit("")))).alias("prefix")).distinct()
        known = index.terms if index.terms is not None else index.postings.select("term").distinct()
        terms = begun.join(prefix_terms(known, begun.select("prefix").distinct()), "prefix", "left")
        unit = F.concat(F.lit("p:"), "prefix").alias("unit")  # one that begins no term stays required, without a term
        rows = rows.unionByName(terms.select("ask", F.lit(REQUIRED).alias("tag"), unit, F.lit(1).alias("size"), F.lit(0).alias("pos"), "term"))
    return rows


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(TERM_SALTS)).cast("int"))


def _on_all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))


def batch_search(
    index: SearchIndex, requests: DataFrame, doc_licenses: DataFrame | None = None
) -> DataFrame:
    """Answers a table of requests together: ``(request_id, rank, doc_id, score, total_count)``.

    ``requests`` has request_id, q, limit, offset, license, category, include_broken,
    include_unfree, and may have the term options any_of, none_of and prefix. Equal texts are scored once, whatever
    filters go with them, and equal searches are ranked once, however many requests ask them; each unit meets the
    postings once, however many searches use it. A frequent term's documents are salted in the joins.
    """
    what = ["q", "license", "category", "include_broken", "include_unfree"]
    what += [c for c in ("any_of", "none_of", "prefix") if c in requests.columns]
    texts = [c for c in ("q", "any_of", "none_of", "prefix") if c in what]
    ask = F.sha2(F.to_json(F.struct(*what)), 256).alias("ask")
    keyed = requests.select("request_id", "limit", "offset", *what, ask)
    text = F.sha2(F.to_json(F.struct(*texts)), 256).alias("text")
    asks = materialize(keyed.groupBy("ask", *what).agg(F.max(_last_row()).alias("depth")).withColumn("text", text), "asks").df
    asked = materialize(tagged_units(index, asks.select(F.col("text").alias("ask"), *texts).distinct()), "asked").df
    units = asked.where("term IS NOT NULL").select("unit", "size", "pos", "term").distinct()
    found = materialize(_on_all_salts(units).join(_salted(index.postings), ["term", "salt"]).drop("salt"), "found").df
    single = found.where(F.col("size") == 1).groupBy("unit", "doc_id").agg(F.sum("tf").alias("f"))
    # An occurrence of a phrase is a start position that all its tokens agree on.
    starts = found.where(F.col("size") > 1).select(
        "unit", "size", "doc_id", "col", "pos", F.explode("positions").alias("at")
    )
    phrase = (
        starts.groupBy("unit", "size", "doc_id", "col", (F.col("at") - F.col("pos")).alias("start"))
        .agg(F.count(F.lit(1)).alias("tokens"))
        .where(F.col("tokens") == F.col("size"))
        .groupBy("unit", "doc_id")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    freq = materialize(single.unionByName(phrase), "frequencies").df
    n_docs, average = index.corpus.select("n").scalar(), index.corpus.select("avgdl").scalar()
    weights = freq.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).select("unit", idf(n_docs, F.col("n")).alias("weight"))
    wants = asked.select("ask", "tag", "unit").distinct()
    sizes = wants.groupBy("ask").agg(F.count_if(F.col("tag") == REQUIRED).alias("units"), F.count_if(F.col("tag") == ANY_OF).alias("choices"))
    counted = wants.join(sizes, "ask").join(weights, "unit")
    per_doc = _on_all_salts(counted).join(_salted(freq), ["unit", "salt"]).drop("salt").join(index.docs, "doc_id")
    term_score = F.when(F.col("tag") != NONE_OF, F.col("weight") * saturation(F.col("f"), F.col("dl"), average))
    filters = [c for c in ["broken", "unfree", "category"] if c in index.docs.columns]
    scored = (
        per_doc.groupBy(F.col("ask").alias("text"), "doc_id", *[F.col(c).alias(f"doc_{c}") for c in filters])
        .agg(
            F.sum(term_score).alias("score"),
            *[F.count_if(F.col("tag") == tag).alias(name) for tag, name in ((REQUIRED, "got"), (ANY_OF, "chosen"), (NONE_OF, "unwanted"))],
            F.max("units").alias("units"),
            F.max("choices").alias("choices"),
        )
        .where("got = units AND (choices = 0 OR chosen > 0) AND unwanted = 0 AND units + choices > 0")
        .select("text", "doc_id", "score", *[f"doc_{c}" for c in filters])
    )
    stored = materialize(scored, "scored").df
    hits = _on_all_salts(asks.drop(*texts)).join(_salted(stored), ["text", "salt"]).drop("text", "salt")
    if "broken" in filters:
        hits = hits.where(F.col("include_broken") | ~F.col("doc_broken"))
    if "unfree" in filters:
        hits = hits.where(F.col("include_unfree") | ~F.col("doc_unfree"))
    if "category" in filters:
        hits = hits.where(F.coalesce(F.col("category") == F.col("doc_category"), F.coalesce("category", F.lit("")) == ""))
    if doc_licenses is not None:
        having = doc_licenses.select("doc_id", F.lower("short_name").alias("name")).distinct()
        named = hits.withColumn("name", F.lower("license")).join(having, ["doc_id", "name"], "left_semi").drop("name")
        hits = hits.where(F.coalesce("license", F.lit("")) == "").unionByName(
            named.where(F.col("license") != "").select(*hits.columns)
        )
    return _rank_pages(hits.select("ask", "depth", "doc_id", "score"), keyed)


def _last_row() -> Column:
    """The deepest rank a request reads; a negative limit reads them all."""
    begin = F.greatest("offset", F.lit(0))
    return F.when(F.col("limit") < 0, F.lit(2**62)).otherwise(F.col("limit").cast("bigint") + begin)


def _rank_pages(hits: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rank the hits of each search as deep as it is read.

    A search that is read a few rows deep is cut to these before the shuffle, by the constant bound. One that is
    read deeper is ranked in salted parts first; what is deeper than ``depth`` in its part cannot be on a page.
    """
    best = [F.desc("score"), F.col("doc_id")]
    place = F.row_number().over(Window.partitionBy("ask").orderBy(*best))
    near = hits.where(F.col("depth") <= min(SHALLOW, DEEP)).withColumn("rn", place).where(F.col("rn") <= SHALLOW)
    ranked = near.where(F.col("rn") <= F.col("depth")).select("ask", F.col("rn").cast("bigint").alias("rank"), "doc_id", "score")
    if keyed.where(_last_row().between(SHALLOW + 1, DEEP)).limit(1).count():
        further = hits.where((F.col("depth") > SHALLOW) & (F.col("depth") <= DEEP))
        salted = further.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_SALTS)))
        in_part = salted.withColumn("rn", F.row_number().over(Window.partitionBy("ask", "salt").orderBy(*best)))
        ranked = ranked.unionByName(
            in_part.where(F.col("rn") <= F.col("depth"))
            .withColumn("rank", place.cast("bigint"))
            .where(F.col("rank") <= F.col("depth"))
            .select("ask", "rank", "doc_id", "score")
        )
    if keyed.where(_last_row() > DEEP).limit(1).count():
        deep = hits.where(F.col("depth") > DEEP).withColumn("_worse", -F.col("score"))
        numbered = number_rows(deep, ["ask", "_worse", "doc_id"], "at")
        before = numbered.groupBy("ask").agg((F.min("at") - 1).alias("before"))
        ranked = ranked.unionByName(
            numbered.join(before, "ask").select("ask", (F.col("at") - F.col("before")).alias("rank"), "doc_id", "score")
        )
    totals = hits.groupBy("ask").agg(F.count(F.lit(1)).alias("total_count"))
    ranked = ranked.join(totals, "ask")
    begin = F.greatest("offset", F.lit(0))
    return (
        keyed.select("request_id", "ask", "limit", "offset")
        .join(ranked, "ask")
        .where((F.col("rank") > begin) & ((F.col("limit") < 0) | (F.col("rank") <= begin + F.col("limit"))))
        .select("request_id", "rank", "doc_id", "score", "total_count")
    )
