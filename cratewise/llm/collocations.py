"""Phrase collocations by vertical partitioning of word suffixes, each group's subtree built on its own.

A phrase counts where it stands whole within a piece. Words, and then pairs of words, that are too rare end every
phrase that would hold them, so only runs of frequent pairs are looked at. Their suffixes of at most five words are
divided by prefix: pairs are taken in the order of a hash until their occurrences fill a budget of rows, which makes
a group; a pair that fills it alone is extended by a word, and again up to five. Suffixes that are
equal within a chunk of text are one row with a count. Each group is sorted and cut into its truncated suffix tree, and a
phrase's count is the total of the leaves below its node; no group needs another.

What tasks are told is bounded: filters of at most ``FILTER_BITS`` bits (a fuller one lets more rows pass and loses
none), and at most ``GROUPS`` group borders and extended prefixes per length, since the budget grows where there would be more.

A word of a language is known by a 64-bit symbol. The counted words are checked to have different symbols; if two
share one, all symbols are drawn anew, so counts are exact.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each time; ties are settled as
far as the phrase; a table without a frequent phrase gives no rows; texts are whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.words import BASE, hash_spans, mix, text_chunks
from cratewise.operators.sequence import running_totals
from cratewise.operators.skew import hot_keys, join_lookup
from cratewise.session import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Suffix rows of a group (56 bytes each in a task), and the most groups; the budget grows where there would be more.
BUDGET, GROUPS = 400_000, 1 << 20
FILTER_BITS = 1 << 28
SALTS = 64
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False


@dataclass
class Filter:
    """A bit set of symbols; two bits each, so what it lets pass besides is about one in a hundred."""

    cells: np.ndarray

    def passes(self, symbols: np.ndarray) -> np.ndarray:
        bits = np.uint64(len(self.cells) * 64 - 1)
        found = np.ones(len(symbols), bool)
        for at in (symbols.view(np.uint64) & bits, (symbols.view(np.uint64) >> np.uint64(36)) & bits):
            found &= (self.cells.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def symbol_filter(symbols: DataFrame, rows: int, most: int = FILTER_BITS) -> Filter:
    """Of the column ``symbol``: 16 bits a row, at most ``most`` in all; one long a cell reaches the driver."""
    bits = min(most, max(1 << 10, 1 << (16 * max(rows, 1) - 1).bit_length()))
    at = F.explode(F.array(F.col("symbol").bitwiseAND(bits - 1), F.shiftrightunsigned("symbol", 36).bitwiseAND(bits - 1))).alias("at")
    mask = F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask")
    found = symbols.select(at).groupBy(F.shiftright("at", 6).alias("cell")).agg(mask).toArrow()
    cells = np.zeros(bits // 64, np.int64)
    cells[found["cell"].to_numpy()] = found["mask"].to_numpy()
    return Filter(cells)


@dataclass
class Cuts:
    """How prefixes of one length are divided: those that are extended, and the last key of each group."""

    extended: np.ndarray
    last: np.ndarray
    counted: Filter | None = None


@dataclass
class Known:
    """What a pass over the texts is told."""

    seed: int
    words: Filter | None = None
    pairs: Filter | None = None
    cuts: dict[int, Cuts] = field(default_factory=dict)


@dataclass
class Chunk:
    """Words of some texts in order; ``follows[i]`` if word ``i + 1`` is the next of the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    symbols: np.ndarray
    follows: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], langs: list[str], seed: int) -> Chunk:
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        edge = np.diff(np.concatenate(([0], _WORD[data].view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)
        follows = np.zeros(len(starts), bool)
        follows[:-1] = breaks[starts[1:]] == breaks[ends[:-1] - 1]
        borders = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, borders)))
        code = {name: int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "little") for name in set(langs)}
        own = np.array([code[name] for name in langs], np.uint64)
        symbols = np.maximum(mix(hash_spans(data, starts, ends) + own[owner]), np.uint64(1)).view(np.int64)
        return cls(data, starts, ends, owner, symbols, follows)


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Chunk, list[str]]]:
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang"))
        for a, b, texts in text_chunks(batch, limit=CHUNK):
            own = langs.slice(a, b - a).to_pylist()
            yield Chunk.of(texts, own, seed), own


def extend(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash that orders prefixes: of a prefix with one more word."""
    return mix(key.view(np.uint64) * np.uint64(BASE) + symbol.view(np.uint64)).view(np.int64)


def _member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def _rows(chunk: Chunk, at: np.ndarray, length: np.ndarray, group: np.ndarray | None = None) -> list[pa.Array]:
    """Distinct runs of ``length`` words from the places ``at``, zeros behind them, with counts; and a group each.

    Runs get exact numbers: those of their first words, times the number of words, plus the next word's.
    """
    words, number = np.unique(chunk.symbols, return_inverse=True)
    name = np.zeros(len(at), np.int64)
    deepest = int(length.max()) if len(length) else 0
    place = np.minimum(at[:, None] + np.arange(deepest), len(chunk.symbols) - 1)
    inside = np.arange(deepest) < length[:, None]
    for k in range(deepest):
        name = np.unique(name * (len(words) + 1) + np.where(inside[:, k], number[place[:, k]] + 1, 0), return_inverse=True)[1]
    _, first, n = np.unique(name, return_index=True, return_counts=True)
    runs = np.zeros((len(first), LONGEST), np.int64)
    runs[:, :deepest] = np.where(inside[first], chunk.symbols[place[first]], 0)
    out = [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(LONGEST)] + [pa.array(n)]
    return out if group is None else [pa.array(group[first]), *out]


_RUN = [f"s{k + 1}" for k in range(LONGEST)]


def _counted_words(docs: DataFrame, seed: int) -> DataFrame:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, langs in _chunks(batches, seed):
            symbols, first, n = np.unique(chunk.symbols, return_index=True, return_counts=True)
            raw = chunk.data.tobytes()
            own = pa.array([raw[a:b] for a, b in zip(chunk.starts[first].tolist(), chunk.ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
            lang = pa.array([langs[i] for i in chunk.owner[first].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(symbols), lang, own, pa.array(n)], names=["symbol", "lang", "word", "n"])

    found = docs.mapInArrow(words, "symbol bigint, lang string, word string, n bigint")
    return found.groupBy("symbol", "lang", "word").agg(F.sum("n").alias("f"))


def _places(chunk: Chunk, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of frequent pairs begin, their words (at most five), and the keys of their pairs."""
    frequent = known.words.passes(chunk.symbols)
    at = np.flatnonzero(chunk.follows & frequent & np.append(frequent[1:], False))
    key = extend(chunk.symbols[at], chunk.symbols[at + 1]) if len(at) else np.empty(0, np.int64)
    if known.pairs is None:
        return at, np.full(len(at), 2), key
    good = known.pairs.passes(key)
    at, key = at[good], key[good]
    paired = np.zeros(len(chunk.symbols) + LONGEST, np.int64)
    paired[at] = 1
    length, runs = np.full(len(at), 2), np.ones(len(at), np.int64)
    for k in range(1, LONGEST - 1):
        runs = runs * paired[at + k]
        length = length + runs
    return at, length, key


def _divided(chunk: Chunk, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places that are still open with their words, the length of their prefix, its key, and whether it is extended."""
    at, length, key = _places(chunk, known)
    depth, extended = np.full(len(at), 2), np.zeros(len(at), bool)
    for d, cuts in sorted(known.cuts.items()):
        if d > 2:  # one more word for the prefixes that were extended
            go = extended & (length >= d)
            key = np.where(go, extend(key, chunk.symbols[np.minimum(at + d - 1, len(chunk.symbols) - 1)]), key)
            open_ = go & cuts.counted.passes(key)
            keep = ~extended | open_
            at, length, key, depth = at[keep], length[keep], key[keep], np.where(open_, d, depth)[keep]
        extended = (depth == d) & _member(key, cuts.extended)
    return at, length, key, depth, extended


def _counted_runs(docs: DataFrame, known: Known, depth: int, least: int) -> DataFrame:
    """Counts of pairs, or of the extended prefixes with one more word, where that is frequent."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches, known.seed):
            if depth == 2:
                at = _places(chunk, known)[0]
            else:
                at, length, _, _, extended = _divided(chunk, known)
                at = at[extended & (length >= depth)]
            yield pa.RecordBatch.from_arrays(_rows(chunk, at, np.full(len(at), depth)), names=[*_RUN, "n"])

    shape = ", ".join(f"{c} bigint" for c in [*_RUN, "n"])
    return docs.mapInArrow(runs, shape).groupBy(*_RUN[:depth]).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _subtrees(docs: DataFrame, known: Known, least: int) -> DataFrame:
    """``(s1 .. s5, a)``: the frequent phrases below the prefixes, read from each group's suffix tree."""
    levels = sorted(known.cuts)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches, known.seed):
            at, length, key, depth, extended = _divided(chunk, known)
            keep = ~extended & (length > depth)
            at, length, key, depth = at[keep], length[keep], key[keep], depth[keep]
            group = np.zeros(len(at), np.int64)
            for d in levels:
                group = np.where(depth == d, (d << 40) + np.searchsorted(known.cuts[d].last, key), group)
            yield pa.RecordBatch.from_arrays(_rows(chunk, at, length, group), names=["grp", *_RUN, "n"])

    def subtree(table: pa.Table) -> pa.Table:
        depth = table["grp"][0].as_py() >> 40
        runs = np.stack([table[c].to_numpy() for c in _RUN], axis=1)
        order = np.lexsort(runs.T[::-1])
        runs, n = runs[order], table["n"].to_numpy()[order]
        fresh = np.ones(len(n), bool)  # a row that begins a node of the depth looked at
        fresh[1:] = (runs[1:, :depth] != runs[:-1, :depth]).any(axis=1)
        out, counts = [], []
        for d in range(depth + 1, LONGEST + 1):
            fresh[1:] |= runs[1:, d - 1] != runs[:-1, d - 1]
            first = np.flatnonzero(fresh)
            total = np.add.reduceat(n, first)
            node = (runs[first, d - 1] != 0) & (total >= least)
            phrase = np.zeros((int(node.sum()), LONGEST), np.int64)
            phrase[:, :d] = runs[first[node], :d]
            out.append(phrase)
            counts.append(total[node])
        found = np.concatenate(out)
        return pa.table([pa.array(np.ascontiguousarray(found[:, k])) for k in range(LONGEST)] + [pa.array(np.concatenate(counts).astype(np.int64))], names=[*_RUN, "a"])

    shape = ", ".join(f"{c} bigint" for c in [*_RUN, "n"])
    grouped = docs.mapInArrow(suffixes, f"grp bigint, {shape}").groupBy("grp")
    return grouped.applyInArrow(subtree, ", ".join(f"{c} bigint" for c in [*_RUN, "a"]))


def _cuts(prefixes: DataFrame, depth: int, budget: int, counted: Filter | None) -> Cuts:
    """Divide frequent prefixes (``key``, ``a``): runs of keys that fill the budget together; what fills it alone is extended."""
    heavy = prefixes.where(F.col("a") > budget) if depth < LONGEST else prefixes.limit(0)
    extended = np.unique(heavy.select("key").toArrow()["key"].to_numpy())
    light = prefixes.where(F.col("a") <= budget).groupBy("key").agg(F.sum("a").alias("a"))
    placed = running_totals(light, ["key"], {"sum": F.col("a")})
    last = placed.groupBy(F.floor((F.col("sum") - 1) / budget).alias("grp")).agg(F.max("key").alias("last")).toArrow()
    return Cuts(extended, np.sort(last["last"].to_numpy()), counted)


def _keyed(prefixes: DataFrame, depth: int) -> DataFrame:
    """With the hash that orders prefixes as ``key``, computed as tasks do."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for k in range(1, depth):
                key = extend(key, batch.column(k).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(depth)], names=["key", "a"])

    return prefixes.select(*_RUN[:depth], "a").mapInArrow(keys, "key bigint, a bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Frequent words ``(symbol, lang, word, f, n)`` and all phrases ``(p, a)`` of 2 to 5 words with ``a >= least``.

    ``p`` is the list of the words' symbols; ``n`` counts all word occurrences of the language.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    for seed in count():
        counted = materialize(_counted_words(texts, seed), "words")
        if counted.df.select("symbol").distinct().count() == counted.rows:
            break
        counted.drop()
    totals = counted.df.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(counted.df.where(F.col("f") >= least).join(totals, "lang").select("symbol", "lang", "word", "f", "n"), "frequent_words")
    known = Known(seed, words=symbol_filter(words.df, words.rows, bits))
    tables = []
    for depth in range(2, LONGEST + 1):
        frequent = materialize(_counted_runs(texts, known, depth, least), "prefixes")
        tables.append(frequent.df.select(F.array(*_RUN[:depth]).alias("p"), "a"))
        keyed = materialize(_keyed(frequent.df, depth), "keys")
        seen = symbol_filter(keyed.df.select(F.col("key").alias("symbol")), keyed.rows, bits)
        if depth == 2:
            known.pairs = seen
            total = keyed.df.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
            budget = max(budget, total // GROUPS)
        known.cuts[depth] = _cuts(keyed.df, depth, budget, seen)
        if not len(known.cuts[depth].extended):
            break
    below = _subtrees(texts, known, least).select(F.filter(F.array(*_RUN), lambda s: s != 0).alias("p"), "a")
    for table in tables:
        below = below.unionByName(table)
    return words.df, materialize(below, "phrases").df


def _part(first: int | Column, size: Column) -> Column:
    return F.slice("p", first, size)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of ``docs`` (``text``, ``lang``)."""
    words, phrases = phrase_counts(docs, least, budget, bits)
    size = F.size("p")
    # a phrase goes where one with one word more is as frequent; any longer one has such a phrase between
    shorter = phrases.where(size > 2).select(F.explode(F.array(_part(1, size - 1), _part(2, size - 1))).alias("p"), F.lit(None).cast("bigint").alias("a"), F.col("a").alias("above"))
    both = phrases.withColumn("above", F.lit(None).cast("bigint")).unionByName(shorter)
    kept = both.groupBy("p").agg(F.max("a").alias("a"), F.max("above").alias("above")).where("above IS NULL OR above < a").select("p", "a")
    kept = materialize(kept, "kept").df

    placed = materialize(kept.select("p", "a", F.posexplode("p").alias("at", "symbol")), "placed")
    named = join_lookup(placed.df, words, "symbol", hot_keys(placed, "symbol"))
    named = named.groupBy("p").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "word", "f", "lang"))).alias("ws"))
    # the counts of parts of two and more words, by the word they begin with and their size
    cut = F.sequence(F.lit(1), size - 1)
    lefts = F.transform(F.filter(cut, lambda k: k > 1), lambda k: F.struct(F.lit(0).alias("begin"), _part(1, k).alias("part")))
    rights = F.transform(F.filter(cut, lambda k: k < size - 1), lambda k: F.struct(k.alias("begin"), F.slice("p", k + 1, size - k).alias("part")))
    parts = materialize(kept.where(size > 2).select("p", F.explode(F.concat(lefts, rights)).alias("x")).select("p", "x.begin", "x.part"), "parts")
    counts = phrases.select(F.col("p").alias("part"), F.col("a").alias("f"))
    found = join_lookup(parts.df, counts, "part", hot_keys(parts, "part"))
    found = found.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("begin"), F.size("part").alias("size")).alias("k"), "f"))).alias("fs"))
    joined = named.join(found, "p", "left").withColumn("m", F.size("p"))
    of = "CASE WHEN {size} = 1 THEN ws[{begin}].f ELSE fs[named_struct('begin', {begin}, 'size', {size})] END"
    sides = f"transform(sequence(1, m - 1), k -> named_struct('k', k, 'l', {of.format(begin='0', size='k')}, 'r', {of.format(begin='k', size='m - k')}))"
    big = "CAST({} AS DECIMAL(19, 0))"
    score = f"(1000 * ({big.format('a')} * {big.format('n')})) div ({big.format('x.l')} * {big.format('x.r')})"
    best = F.expr(f"array_min(transform({sides}, x -> named_struct('score', {score}, 'k', x.k, 'l', x.l, 'r', x.r)))")
    scored = joined.select(
        F.col("ws")[0]["lang"].alias("lang"), F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("phrase"), "a", "n", best.alias("b")
    ).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
