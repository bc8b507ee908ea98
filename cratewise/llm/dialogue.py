"""Repair of conversations by cheapest edits, with Four-Russians block tables.

A conversation's rows are symbols: the role's initial, whether the text is cut short, or that the row must
go. Repaired initials are ``(s?(ua)+)?``, an automaton of four states, so the cheapest edits of the rows
from one place on are a vector of four costs. Less its minimum, such a vector is one of a few,
and ``Tables`` holds for each of these and every block of ``BLOCK`` symbols the vector before the block and what
it costs. A conversation is read from its last block to its first by lookup; then its blocks are expanded in
the opposite order, each step taking the smallest letter that keeps the total, so ties are exact.

Rows that are equal are counted before they are shuffled. Ranges of rows in conversation order become one byte per
row each, so a conversation with a third of all rows is classified by many tasks; only these bytes, which are as many as
the letters of its audit, meet in one task. Repaired rows then stream through sorted partitions with the audit in
front; nothing but the audit is held. (The digest of a conversation is one SHA-256 stream, so it has one reader.)

Edits: ``K`` keep 0, ``R`` rerole to the turn that is due 3, ``D`` delete 4 (required for blank and duplicate
rows), ``I`` insert an empty turn 3; a row with a truncated text that stays costs 3 more.

Defined results: a null role or text counts as one space; null turns come first; rows of one turn come in the order of
role and of the SHA-256 of the text; conversations without an id are one conversation; an empty role has no
legal place; a conversation without rows has no edits and the hash of the empty string; an empty table gives no
rows; texts are whole, however long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cratewise.session import materialize

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: initials s, u, a and any other; the same with a truncated text; a row that must go; no row.
GONE, PAD, SYMBOLS = 8, 9, 10
#: The state after keeping an initial, and the state that the due turn leads to.
AFTER = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
DUE = (USER, USER, ASSISTANT, USER)
#: Costs when no row is left: a finished conversation, or the turns that are missing.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
WHITE = " \t\n\x0b\x0c\r"


class Tables:
    """Transitions of normalised cost vectors for symbols and for blocks of ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.number = [END], {END: 0}
        self.step: list[list[tuple[int, int]]] = []  # by vector and symbol: cost, vector before
        self.moves: list[list[list[tuple[str, int]]]] = []  # and by state: letters, state after
        for after in self.vectors:  # grows while it is read, until no vector is new
            rows = [self._before(after, symbol) for symbol in range(SYMBOLS)]
            self.moves.append([moves for _, moves in rows])
            self.step.append([])
            for costs, _ in rows:
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                self.step[-1].append((least, self.number[vector]))
        cost, before = (np.array([[s[i] for s in row] for row in self.step]) for i in (0, 1))
        codes = np.arange(SYMBOLS**block)
        at = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        total = np.zeros_like(at)
        for k in reversed(range(block)):
            digit = codes // SYMBOLS**k % SYMBOLS
            total += cost[at, digit]
            at = before[at, digit]
        self.cost, self.before = total.tolist(), at.tolist()
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    @staticmethod
    def _before(after: tuple[int, ...], symbol: int) -> tuple[list[int], list[tuple[str, int]]]:
        """Costs before a symbol, and the letters that reach them, smallest first, from each state."""
        if symbol == PAD:
            return list(after), [("", state) for state in range(4)]
        extra = TRUNCATED if symbol >= 4 else 0
        kept: list[int | None] = [None if symbol == GONE else AFTER.get((state, symbol % 4)) for state in range(4)]
        costs = []
        for state in range(4):
            ways = [after[state] + DELETE]
            if symbol != GONE:
                ways.append(after[DUE[state]] + REROLE + extra)
            if kept[state] is not None:
                ways.append(after[kept[state]] + KEEP + extra)
            costs.append(min(ways))
        for _ in range(4):  # insertions before the row
            costs = [min(costs[state], costs[DUE[state]] + INSERT) for state in range(4)]
        moves = []
        for state in range(4):
            at, letters = state, ""
            while True:
                if after[at] + DELETE == costs[at]:
                    letters += "D"
                elif costs[DUE[at]] + INSERT == costs[at]:
                    letters, at = letters + "I", DUE[at]
                    continue
                elif kept[at] is not None and after[kept[at]] + KEEP + extra == costs[at]:
                    letters, at = letters + "K", kept[at]
                else:
                    letters, at = letters + "R", DUE[at]
                break
            moves.append((letters, at))
        return costs, moves

    def expand(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The letters of a block that is followed by the vector ``after`` and entered in ``state``."""
        key = (after, code, state)
        if key not in self.expanded:
            digits = [code // SYMBOLS**k % SYMBOLS for k in range(self.block)]
            inside = [after]
            for digit in reversed(digits[1:]):
                inside.append(self.step[inside[-1]][digit][1])
            letters = ""
            for digit, follows in zip(digits, reversed(inside), strict=True):
                more, state = self.moves[follows][digit][state]
                letters += more
            self.expanded[key] = (letters, state)
        return self.expanded[key]

    def audit(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost of a conversation and its edits' letters, the smallest of equal cost."""
        short = -len(symbols) % self.block
        padded = np.concatenate((np.full(short, PAD), symbols)).reshape(-1, self.block)
        blocks = (padded @ SYMBOLS ** np.arange(self.block)).tolist()
        total, vector, follows = 0, 0, []
        for code in reversed(blocks):
            follows.append(vector)
            total += self.cost[vector][code]
            vector = self.before[vector][code]
        state, letters = START, []
        for code in blocks:
            more, state = self.expand(follows.pop(), code, state)
            letters.append(more)
        return total + self.vectors[vector][START], "".join(letters) + TAIL[state]


_TABLES: list[Tables] = []


def tables() -> Tables:
    if not _TABLES:
        _TABLES.append(Tables())
    return _TABLES[0]


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows damaged by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("fault", fault).where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Codes of a byte: initial + 4 * fault, the first that applies.
SOUND, CUT, BLANK, TWIN = range(4)


def marked(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, copies, initial, fault)``, one row for equal ones; the first may be no duplicate."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 0), ("u", 1), ("a", 2)) for x in pair]), F.left("role", F.lit(1))), F.lit(3))
    own = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    equal = rows.groupBy("conv_id", "turn", "role", _digest(F.col("text")).alias("digest")).agg(F.sum("copies").alias("copies"), F.max(own).alias("own"))
    equal = materialize(equal, "turns").df
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = equal.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & (order > F.col("first"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(later, TWIN).otherwise(F.col("own"))
    return equal.join(first, same, "left").select("conv_id", "turn", "role", "digest", "copies", initial.alias("initial"), fault.alias("fault"))


def _segments(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation as bytes, with their first, last and number of turns."""
    part = TaskContext.get().partitionId()
    open_run: list[Any] = []  # id, codes, first, last, distinct turns

    def close() -> pa.RecordBatch:
        values = [[open_run[0]], [part], [bytes(open_run[1])], *[[x] for x in open_run[2:]]]
        kinds = [conv, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "part", "codes", "first", "last", "turns"])

    for batch in batches:
        for name, turn, copies, initial, fault in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "copies", "initial", "fault")], strict=True):
            if open_run and open_run[0] != name:
                yield close()
                open_run = []
            if not open_run:
                open_run = [name, bytearray(), None, None, 0]
            open_run[1].append(initial + 4 * fault)
            if copies > 1:
                open_run[1] += bytes([initial + 4 * (fault if fault == BLANK else TWIN)]) * (copies - 1)
            if turn is not None and turn != open_run[3]:
                open_run[2:] = [turn if open_run[2] is None else open_run[2], turn, open_run[4] + 1]
    if open_run:
        yield close()


#: Legal pairs of initials: s before u, and u and a in turn.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _facts(segments: list[dict]) -> list:
    """Counts, cost and audit of a conversation from its segments."""
    segments = sorted(segments, key=lambda s: s["part"])
    codes = np.frombuffer(b"".join(s["codes"] for s in segments), np.uint8)
    initial, fault = codes % 4, codes // 4
    known = [s for s in segments if s["turns"]]
    shared = sum(a["last"] == b["first"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["last"] - known[0]["first"] + 1 - sum(s["turns"] for s in known) + shared if known else 0
    illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum()) if len(codes) else 0
    symbols = np.where(fault >= BLANK, GONE, initial + 4 * (fault == CUT)).astype(np.int64)
    cost, audit = tables().audit(symbols)
    return [gaps, *[int((fault == f).sum()) for f in (BLANK, TWIN, CUT)], illegal, cost, audit]


def audits(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for every id of ``names``."""
    conv = rows.schema["conv_id"]
    keys = ["conv_id", "turn", "role", "digest"]
    ranged = marked(rows).withColumn("turn", F.col("turn").cast("bigint")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    arrow = pa.schema(ranged.select("conv_id").limit(0).toArrow().schema).field(0).type
    shape = StructType([conv]).add("part", "integer").add("codes", "binary").add("first", "long").add("last", "long").add("turns", "long")
    segments = ranged.select("conv_id", "turn", "copies", "initial", "fault").mapInArrow(lambda it: _segments(it, arrow), shape)
    none = names.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(b"").alias("codes"), *[F.lit(None).cast("bigint").alias(c) for c in ("first", "last")], F.lit(0).cast("long").alias("turns"))
    whole = segments.unionByName(none).groupBy("conv_id").agg(F.collect_list(F.struct("part", "codes", "first", "last", "turns")).alias("segments"))
    out = StructType([conv, *[StructField(c, LongType()) for c in FACTS], StructField("audit", StringType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * len(FACTS) + [pa.string()]
        for batch in batches:
            found = [_facts(own) for own in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=out.names)

    return whole.mapInArrow(judged, out)


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of every conversation in order, behind one row with its facts."""
    facts = found.select("conv_id", F.lit(0).alias("kind"), F.struct(*FACTS, "audit").alias("facts"))
    turns = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", _digest(F.col("text")).alias("digest"))
    both = facts.unionByName(turns, allowMissingColumns=True)
    keys = ["conv_id", "kind", "turn", "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "kind", "facts", "role", "text", "copies")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Any, Any, Any]]:
    """Of every conversation ``("open", id, facts, None)``, then ``("turn", id, role, text)`` for its repaired rows."""
    name, letters, at, state = None, "", 0, START

    def due() -> str:
        return "assistant" if DUE[state] == ASSISTANT else "user"

    for batch in batches:
        for row in (row for begin in range(0, batch.num_rows, 200) for row in batch.slice(begin, 200).to_pylist()):
            if row["kind"] == 0:
                while at < len(letters):  # what is inserted behind the last row
                    yield "turn", name, due(), ""
                    at, state = at + 1, DUE[state]
                name, letters, at, state = row["conv_id"], row["facts"]["audit"], 0, START
                yield "open", name, row["facts"], None
                continue
            for _ in range(row["copies"]):
                while letters[at] == "I":
                    yield "turn", name, due(), ""
                    at, state = at + 1, DUE[state]
                edit, at = letters[at], at + 1
                if edit == "D":
                    continue
                role = row["role"] if edit == "K" else due()
                state = AFTER[state, {"s": 0, "u": 1, "a": 2}[role[0]]]
                yield "turn", name, role, row["text"]
    while at < len(letters):
        yield "turn", name, due(), ""
        at, state = at + 1, DUE[state]


def _tabled(rows: Iterator[list], shape: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 50 + sum(len(x) for x in row if isinstance(x, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)


def _arrow(df: DataFrame, shape: StructType) -> pa.Schema:
    return df.sparkSession.createDataFrame([], shape).toArrow().schema


def _ready(rows: DataFrame, copies: Column) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("bigint").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the repaired conversations of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``)."""
    own = rows.select("conv_id", "turn", "role", "text")
    ready = _ready(own, F.lit(1))
    out = StructType([own.schema["conv_id"]]).add("position", "long").add("role", "string").add("text", "string")
    shape = _arrow(own, out)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[list]:
            n = 0
            for kind, name, role, text in _edited(batches):
                n = 0 if kind == "open" else n + 1
                if n:
                    yield [name, n, role, text]

        return _tabled(numbered(), shape)

    return _stream(ready, audits(ready, own)).mapInArrow(repaired, out)


def repair_digest(rows: DataFrame, names: DataFrame, copies: str | None = None) -> DataFrame:
    """Facts, cost, audit and the SHA-256 of the repaired rows for every conversation of ``names``.

    ``copies`` names a column of how often a row stands in its place. The repaired rows are hashed as they stream.
    """
    ready = _ready(rows, F.lit(1) if copies is None else F.col(copies))
    out = StructType([ready.schema["conv_id"], *[StructField(c, LongType()) for c in FACTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    shape = _arrow(rows, out)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[list]:
            row: list = []
            stream = hashlib.sha256()
            between = b""
            for kind, name, a, b in _edited(batches):
                if kind == "open":
                    if row:
                        yield [*row, stream.hexdigest()]
                    row, stream, between = [name, *[a[c] for c in FACTS], a["audit"]], hashlib.sha256(), b""
                else:
                    stream.update(between + f"{a}:{b}".encode())
                    between = b"\n"
            if row:
                yield [*row, stream.hexdigest()]

        return _tabled(hashed(), shape)

    return _stream(ready, audits(ready, names)).mapInArrow(digested, out)
