"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

1. Every text becomes a set of 64-bit shingle hashes. A shingle that no other text has cannot
   count towards an overlap, so tasks send each distinct shingle of a chunk of texts once to the
   shingle's shard and learn which ones are repeated. A text with fewer repeated shingles than the
   least overlap of any partner, ``ceil(0.8 n)``, is settled.
2. Equal sets form classes; only one set per class goes on, and rarity is counted over classes.
3. Sets that share one of their rarest shingles (as many as can be missed) form families; a linked
   pair is always in one family. Families larger than a block are dealt out as pairs of blocks.
4. In each task, a set's short inverted lists are merged, candidates with enough occurrences are
   probed in its long lists by binary search, and those that reach the overlap link.
5. Links become components. Only spanning links and link counts leave a task.

Defined results: null and empty texts have no shingles and no links; a text of fewer words than the
shingle width has its whole sequence as one shingle; repeated rows are nodes of their own and link
(they are one class); rows with a null id take part, and a component is named by its smallest
non-null id (null if it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.columns import spare
from cratewise.llm.words import mix, shingle_sets, text_chunks
from cratewise.operators.components import wcc
from cratewise.session import materialize

WIDTH = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles that one task of step 4 holds of each of its two blocks.
BLOCK_KEYS = 1 << 20
KNOWN = 0xFFFF  # in place of a text's number: the chunk itself has the shingle twice
#: Classes that are unpacked into rows at once.
UNPACK_ROWS = 200
LOW = np.uint64((1 << 48) - 1)

_SENT = "shard int, rid binary, doc_id binary, n binary, sig binary, low binary, high binary, texts binary, base bigint, known_rid binary, known_keys binary"
_FACTS = "rid bigint, doc_id bigint, uid bigint, n bigint, sig1 bigint, sig2 bigint, keys binary"
_REPLIES = "base bigint, rid binary, doc_id binary, n binary, sig binary, known_rid binary, known_keys binary"
_REPLY = pa.schema([("base", pa.int64()), *[(c, pa.binary()) for c in ("rid", "doc_id", "n", "sig", "known_rid", "known_keys")]])


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """The smallest overlap of a set of ``n`` with any partner it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _sets(batches: Iterator[pa.RecordBatch], shards: int, width: int) -> Iterator[pa.RecordBatch]:
    """Messages of a task's texts to the shards: one row per chunk of texts and shard."""
    row = TaskContext.get().partitionId() << 40
    schema = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("rid", "doc_id", "n", "sig", "low", "high", "texts")], ("base", pa.int64()), ("known_rid", pa.binary()), ("known_keys", pa.binary())])
    turn = row >> 40
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for a, b, texts in text_chunks(batch, limit=4 << 20, rows=KNOWN - 1):
            sets = shingle_sets([t.lower() for t in texts], width)  # bytes: A-Z only
            n = np.fromiter(map(len, sets), np.int64, b - a)
            keys = np.concatenate([*sets, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(b - a, dtype=np.uint16), n)
            sig = np.zeros((b - a, 2), np.int64)
            if len(keys):
                full, starts = n > 0, (np.cumsum(n) - n)[n > 0]
                for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    sig[full, k] = np.add.reduceat(mix(keys ^ np.uint64(salt)), starts).view(np.int64)
            shard = ((keys >> np.uint64(48)) % np.uint64(shards)).astype(np.int64)
            # the identity of a shingle from here on: its shard and its 48 low bits
            keys = (keys & LOW) | (shard.astype(np.uint64) << np.uint64(48))
            order = np.argsort(keys, kind="stable")
            keys, owner, shard = keys[order], owner[order], shard[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(keys)))
            known = np.repeat(times > 1, times)
            by = np.argsort(owner[known], kind="stable")
            known_rid = owner[known][by].astype(np.int64) + row
            known_keys = keys[known][by]
            once, texts_once, shard_once = keys[at], np.where(times > 1, KNOWN, owner[at]).astype(np.uint16), shard[at]
            cut = np.searchsorted(shard_once, np.arange(shards + 1))
            rows = []
            for s in range(shards):
                x = slice(cut[s], cut[s + 1])
                if cut[s + 1] > cut[s]:
                    rows.append((s, None, None, None, None, (once[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((once[x] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), texts_once[x].tobytes(), row, None, None))
            turn += 1
            own_ids = ids.slice(a, b - a).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            nulls = np.asarray(ids.slice(a, b - a).is_null().to_numpy(zero_copy_only=False), bool)
            uid = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
            rows.append((int(turn % shards), np.arange(row, row + b - a, dtype=np.int64).tobytes(), np.concatenate((own_ids, nulls.astype(np.int64), uid)).tobytes(), n.tobytes(), sig.tobytes(), None, None, None, row, known_rid.tobytes(), known_keys.tobytes()))
            row += b - a
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _repeated(table: pa.Table) -> pa.Table:
    """Of one shard: which shingles more than one text has, one row per chunk that asked; facts pass through."""
    low, high, who, base = [], [], [], []
    for r in table.select(["low", "high", "texts", "base"]).to_pylist():
        if r["low"] is not None:
            low.append(np.frombuffer(r["low"], np.uint32))
            high.append(np.frombuffer(r["high"], np.uint16))
            who.append(np.frombuffer(r["texts"], np.uint16))
            base.append(np.full(len(who[-1]), r["base"]))
    out = [table.filter(pc.is_null(table["low"])).select(_REPLY.names)]
    if low:
        shard = np.uint64(table["shard"][0].as_py())
        keys = np.concatenate(high).astype(np.uint64) << np.uint64(32) | np.concatenate(low) | shard << np.uint64(48)
        who, base = np.concatenate(who), np.concatenate(base)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[who[order] != KNOWN]
        order = order[np.argsort(base[order], kind="stable")]
        keys, who, base = keys[order], who[order], base[order]
        chunk, at = np.unique(base, return_index=True)
        cut = np.append(at, len(base))
        rid, blob = zip(*[((base[x:y] + who[x:y]).tobytes(), keys[x:y].tobytes()) for x, y in zip(cut, cut[1:])]) if len(chunk) else ((), ())
        nulls = [pa.nulls(len(chunk), pa.binary())] * 4
        out.append(pa.Table.from_arrays([pa.array(chunk, pa.int64()), *nulls, pa.array(rid, pa.binary()), pa.array(blob, pa.binary())], schema=_REPLY))
    return pa.concat_tables([t.cast(_REPLY) for t in out])


def _assembled(table: pa.Table) -> pa.Table:
    """Of one chunk: a row per text with its repeated shingles, if they are enough to link."""
    facts = next(r for r in table.to_pylist() if r["rid"] is not None)
    rid, n = np.frombuffer(facts["rid"], np.int64), np.frombuffer(facts["n"], np.int64)
    (ids, nulls, uid), sig = np.split(np.frombuffer(facts["doc_id"], np.int64), 3), np.frombuffer(facts["sig"], np.int64).reshape(-1, 2)
    who = np.frombuffer(b"".join(table["known_rid"].to_pylist()), np.int64)
    keys = np.frombuffer(b"".join(table["known_keys"].to_pylist()), np.uint64)
    order = np.argsort(who, kind="stable")
    keys, cut = keys[order], np.searchsorted(who[order], np.append(rid, rid[-1:] + 1))
    enough = (np.diff(cut) >= least_overlap(n)) & (n > 0)
    blobs = [np.sort(keys[x:y]).tobytes() if e else None for x, y, e in zip(cut, cut[1:], enough)]
    columns = [pa.array(rid), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(uid), pa.array(n), pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy()), pa.array(blobs, pa.binary())]
    return pa.Table.from_arrays(columns, names=["rid", "doc_id", "uid", "n", "sig1", "sig2", "keys"])


def repeated_shingles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(rid, doc_id, uid, n, sig1, sig2, keys)`` per row of ``docs``: hash of id and text, set size, a 128-bit
    value of the set, and its shingles that other rows have too (8 bytes each), null where too few to link.

    Messages and replies are one row per chunk of texts and shard; neither grows with how common a shingle is.
    """
    shards = min(1 << 16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text").mapInArrow(lambda it: _sets(it, shards, width), _SENT)
    replies = sent.groupBy("shard").applyInArrow(_repeated, _REPLIES)
    return replies.groupBy("base").applyInArrow(_assembled, _FACTS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and shingle, a bounded number of classes at a time."""
    for b in batches:
        for at in range(0, b.num_rows, UNPACK_ROWS):
            part = b.slice(at, UNPACK_ROWS)
            cls, n = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keys = [np.frombuffer(p, np.int64) for p in part.column(2).to_pylist()]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls, size)), pa.array(np.repeat(n, size)), pa.array(np.concatenate(keys))], names=["cls", "n", "key"])


def divide_skip(sizes: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For sets of distinct shingle numbers: the smallest linked-up index of each set, and the weights it links with.

    ``sizes`` are whole set sizes, ``sets`` may leave out shingles that no other set here has. With
    ``side`` (False, True per set) only pairs across the sides are looked for.
    """
    order = np.argsort(sizes, kind="stable")  # partners of the r-th set stand before it and are no larger
    m = sizes[order]
    keys, inverse = np.unique(np.concatenate([*[sets[i] for i in order], np.empty(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    by = np.argsort(inverse, kind="stable")
    lists, begin = owner[by], np.searchsorted(inverse[by], np.arange(len(keys) + 1))
    cuts = np.cumsum([0, *[len(sets[i]) for i in order]])
    label, links = np.arange(len(order)), np.zeros(len(order), np.int64)
    w = weight[order]
    sides = None if side is None else side[order]
    for r in range(1, len(order)):
        lo = int(np.searchsorted(m, least_overlap(int(m[r]))))  # length bound
        if lo >= r:
            continue
        tokens = inverse[cuts[r] : cuts[r + 1]]
        own = [lists[begin[t] : begin[t + 1]] for t in tokens]
        own = [x[np.searchsorted(x, lo) : np.searchsorted(x, r)] for x in own]
        own = sorted((x for x in own if len(x)), key=len)
        need = -(-4 * (int(m[r]) + int(m[lo])) // 9)  # overlap that the smallest partner needs
        if len(own) < need:
            continue
        # A long list costs a binary search per candidate, a short one a merge step per entry.
        length = np.fromiter(map(len, own), np.int64, len(own))
        skip = _long_lists(length, need, r - lo)
        short = np.sort(np.concatenate(own[: len(own) - skip]), kind="stable")  # a merge of sorted runs
        at = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        found, times = short[at], np.diff(np.append(at, len(short)))
        enough = times >= need - skip
        found, times = found[enough], times[enough]
        if sides is not None:
            across = sides[found] != sides[r]
            found, times = found[across], times[across]
        for k, x in enumerate(own[len(own) - skip :]):
            if not len(found):
                break
            p = np.searchsorted(x, found)
            times = times + (x[np.minimum(p, len(x) - 1)] == found)
            alive = times + (skip - k - 1) >= need
            found, times = found[alive], times[alive]
        found = found[9 * times >= 4 * (m[r] + m[found])]
        if len(found):
            links[r] += w[found].sum()
            links[found] += w[r]
            old = np.unique(np.append(label[found], label[r]))
            label[np.isin(label, old)] = old[0]
    root, degree = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    root[order], degree[order] = order[label], links
    return root, degree


def _long_lists(length: np.ndarray, need: int, docs: int) -> int:
    """How many of the longest lists to probe instead of merging: the cheapest by a cost estimate."""
    total = np.concatenate(([0], np.cumsum(length)))
    skip = np.arange(0, min(need - 1, len(length)) + 1)
    merged = total[len(length) - skip]
    candidates = np.minimum(docs, merged // (need - skip))
    return int(skip[np.argmin(merged + skip * (40 + candidates * 4))])


def _family(table: pd.DataFrame) -> pd.DataFrame:
    """Links within one family, or between two of its blocks."""
    i, j = int(table["i"].iloc[0]), int(table["j"].iloc[0])
    table = table.sort_values("cls", ignore_index=True)
    sets = [np.frombuffer(k, np.uint64) for k in table["keys"]]
    root, links = divide_skip(table["n"].to_numpy(), sets, table["copies"].to_numpy(), None if i == j else (table["block"] == j).to_numpy())
    return pd.DataFrame({"cls": table["cls"], "root": table["cls"].to_numpy()[root], "links": links})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of longs as bytes, sorted."""
    for b in batches:
        blobs = [np.sort(np.asarray(k, np.int64).view(np.uint64)).tobytes() for k in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blobs, pa.binary())], names=b.schema.names)


def linked_rows(docs: DataFrame, width: int = WIDTH, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(doc_id, uid, n, component, component_id, n_links)`` per row of ``docs`` (``doc_id``, ``text``).

    ``component`` is null for rows that cannot link with any other.
    """
    facts = materialize(repeated_shingles(docs, width), "sets").df
    which = ["n", "sig1", "sig2"]
    alive = facts.where(F.col("keys").isNotNull())
    classes = materialize(alive.groupBy(*which).agg(F.min("rid").alias("cls"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "classes").df
    heads = alive.join(classes.select(F.col("cls").alias("rid"), "copies"), "rid")
    postings = materialize(heads.select(F.col("rid").alias("cls"), "n", "keys").mapInArrow(_unpack, "cls bigint, n bigint, key bigint"), "postings").df
    often = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    listed = (
        postings.join(often, "key")
        .groupBy("cls", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare"))
        .where(F.size("rare") >= least)
        .join(classes.select("cls", "copies"), "cls")
    )
    prefix = F.slice("rare", F.lit(1), (F.size("rare") - least + 1).cast("int"))
    ready = materialize(
        listed.select("cls", "n", "copies", F.transform(prefix, lambda x: x["key"]).alias("prefix"), F.transform("rare", lambda x: x["key"]).alias("keys")), "ready"
    ).df
    tokens = materialize(ready.select("cls", F.explode("prefix").alias("key")), "prefix").df
    lowest = tokens.groupBy("key").agg(F.min("cls").alias("dst"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = tokens.join(lowest, "key").where("cls <> dst").select(F.col("cls").alias("src"), "dst").distinct()
    families = wcc(edges, ready.select(F.col("cls").alias("node_id"))).select(F.col("node_id").alias("cls"), F.col("component").alias("family"))
    member = materialize(families, "families").df
    sized = ready.join(member, "cls")
    blocks = sized.groupBy("family").agg(F.ceil(F.sum(F.size("keys")) / block_keys).cast("int").alias("blocks"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    placed = sized.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = placed.select(
        "family", "cls", "n", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "keys"
    ).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "copies", "keys")
    packed = dealt.mapInArrow(_pack, "family bigint, i int, j int, block int, cls bigint, n bigint, copies bigint, keys binary")
    found = materialize(packed.groupBy("family", "i", "j").applyInPandas(_family, "cls bigint, root bigint, links bigint"), "links").df
    linked = wcc(found.where("cls <> root").select(F.col("cls").alias("src"), F.col("root").alias("dst")), found.select(F.col("cls").alias("node_id")))
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(linked.withColumnRenamed("node_id", "cls"), "cls", "left").join(degree, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select(*which, "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return facts.join(named, which, "left").select(
        "doc_id",
        "uid",
        "n",
        "component",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def jaccard_components(docs: DataFrame, width: int = WIDTH, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` per row of ``docs``.

    ``n_links`` counts the other rows whose similarity is at least 0.8.
    """
    return linked_rows(docs, width, block_keys).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component with the smallest id (null last, then by a hash of the text), with its columns.

    Rows without shingles all stay; of rows that are equal in id and text one stays.
    """
    rows = materialize(linked_rows(docs).select("doc_id", "uid", "component"), "linked").df
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("uid")
    uid, one, nth = spare(docs, "_uid", "_one", "_nth")
    heads = rows.where(F.col("component").isNotNull()).groupBy("component").agg(first).select("uid", F.lit(True).alias(one))
    kept = rows.where(F.col("component").isNull()).select("uid", F.lit(False).alias(one)).distinct().unionByName(heads)
    marked = docs.withColumn(uid, F.xxhash64("doc_id", "text")).join(kept.withColumnRenamed("uid", uid), uid)
    place = F.row_number().over(Window.partitionBy(uid).orderBy(uid))
    return marked.withColumn(nth, place).where(~F.col(one) | (F.col(nth) == 1)).select(*docs.columns)
