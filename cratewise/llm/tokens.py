"""Token ids of documents in fixed-width bit-packed blocks.

File format: a folder of Parquet files whose rows are blocks, in ascending order of ``doc_id`` within
and across shards. A block holds whole documents, about ``BLOCK_IDS`` ids of them:

- ``shard``, ``block``: place of the block; ``first``: ids before it in its shard; ``n``: its ids
- ``bits``: width of an id, the fewest that hold the vocabulary
- ``doc_id``, ``start``: its documents and where each begins in the block
- ``payload``: id *k* in bits ``[k * bits, (k + 1) * bits)``, least significant bit first

Offsets are in the rows, so readers skip to a block by the columns' statistics and unpack any run of
ids without the rest. Blocks are written through Spark, so any shared store will do, and only files of
committed tasks are read.

Defined results: null and empty texts are the end id alone; repeated rows are written as often as they
come, equal ids in the order of the texts' hash; null ids come first; a document is in one block,
however long; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratewise.llm.words import hash_spans, mix, spans, text_chunks
from cratewise.session import run_folder

END_ID = 2
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker remembers (about 25 bytes each), and runs of texts with odd white space (200 bytes).
REMEMBERED, REMEMBERED_RUNS = 4_000_000, 200_000
#: Words that are encoded as one text.
JOINED = 200

BLOCKS = "shard int, block int, first bigint, n bigint, bits int, doc_id array<bigint>, start array<bigint>, payload binary"

# Runs between which the tokenizer's splitting never joins or looks: a word with the space before it,
# or white space. The white space is Unicode's property, fixed by the tokenizer's pattern.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUNS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# Bytes that are or may begin white space other than a space or a line end; what follows the latter.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf")
# Characters on which libraries differ whether they are white space.
_DOUBTFUL = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits; eight ids fill ``bits`` whole bytes."""
    if bits in (8, 16, 32):  # whole bytes: the same layout, without shifts
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 8)
    out = np.zeros((groups, bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        field = padded[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, byte + j] |= ((field >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a payload; only their bytes are looked at."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[begin:end].astype(np.uint32)
    group = begin // 8
    n = end - group * 8
    groups = -(-n // 8)
    data = np.frombuffer(payload, np.uint8)[group * bits : (group + groups) * bits]
    whole = np.zeros(groups * bits, np.uint8)
    whole[: len(data)] = data
    rows = np.zeros((groups, bits + 8), np.uint64)
    rows[:, :bits] = whole.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        field = np.zeros(groups, np.uint64)
        for j in range((shift + bits + 7) // 8):
            field |= rows[:, byte + j] << np.uint64(8 * j)
        out[:, k] = ((field >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    return out.reshape(-1)[begin - group * 8 : n]


class Encoder:
    """A tokenizer that encodes each distinct word once, as its splitting never looks across them.

    Words are known by a 64-bit hash of their bytes and of what stands before them: nothing, a space or
    a line end. Texts with any other white space are split into runs, or given to the library whole. With
    ``added``, the string of an added token in a text is that token, as it is for the library; such texts are
    given to it whole. Without, it is ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a run never holds one that counts
        self.whole, self.added = self.library, None
        tokens = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        if added and tokens:
            self.whole = Tokenizer.from_file(path)
            self.added = re.compile(b"|".join(map(re.escape, tokens)))
        self.size = self.library.get_vocab_size()
        with open(path) as file:
            kind = json.load(file)["pre_tokenizer"] or {}
        self.by_word = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space")
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.opens = np.zeros(self.size, bool)  # ids whose bytes begin with a space
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.runs: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        """Sorted hashes of the known words, where their ids are, and these ids one after another."""
        self.known, self.at, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(0, self.dtype), 0

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text, without the end id."""
        odd = self._irregular(texts) if self.by_word else np.ones(len(texts), bool)
        named = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        odd[named] = False
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        plain = np.setdiff1d(np.flatnonzero(~odd), named).astype(int).tolist()
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd(texts[i].decode())
        for i in named:
            out[i] = self._whole(texts[i].decode())
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)

    @staticmethod
    def _irregular(texts: list[bytes]) -> np.ndarray:
        """Texts that are empty or have anything but single spaces and line ends between words."""
        raw = b"\n" + b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        white = (data == 32) | (data == 10)
        pairs = np.flatnonzero(white[1:] & white[:-1])
        wide = [x for x in np.flatnonzero(_LEAD[data]).tolist() if _WIDE.match(raw, x)]
        at = np.concatenate((pairs, pairs + 1, np.flatnonzero(_ODD[data]), np.array(wide, np.int64)))
        # a text lies between two line ends; a pair that has one of them is at its edge
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begin = 1 + np.cumsum(sizes) - sizes
        out = sizes == 1
        own = np.searchsorted(begin, at, side="right") - 1
        inside = (own >= 0) & (at < begin[own] + sizes[own] - 1)
        out[own[inside]] = True
        return out

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of texts whose words have one space or line end between them."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = spans(data)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        before = np.where(data[starts - 1] == 32, 1, 2)  # a space or a line end
        before[first[:-1]] = 0
        hashes = mix(hash_spans(data, starts, ends) + before.astype(np.uint64))
        words, where, place = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.known, words)
        missing = np.flatnonzero(self.known[np.minimum(found, len(self.known) - 1)] != words) if len(self.known) else np.arange(len(words))
        if len(missing):
            if len(self.known) + len(missing) > REMEMBERED:
                self.forget()
                missing = np.arange(len(words))
            raw, lead = data.tobytes(), ("", " ", "\n")
            some = where[missing]
            runs = [lead[p] + raw[x:y].decode() for p, x, y in zip(before[some].tolist(), starts[some].tolist(), ends[some].tolist(), strict=True)]
            order, ids, length = self._runs(runs)
            self._learn(words[missing][order], ids, length)
            found = np.searchsorted(self.known, words)
        at, length = self.at[found][place], self.length[found][place]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.repeat(at - total[:-1], length) + np.arange(total[-1])]
        return np.split(ids, total[first[1:-1]])

    def _learn(self, words: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(need, 2 * self.used) - self.used, self.dtype)))
        self.ids[self.used : need] = ids
        at = self.used + np.cumsum(length) - length
        self.used = need
        order = np.argsort(words)
        words, at, length = words[order], at[order], length[order]
        place = np.searchsorted(self.known, words)
        self.known, self.at, self.length = (np.insert(x, place, y) for x, y in ((self.known, words), (self.at, at), (self.length, length)))

    def _odd(self, text: str) -> np.ndarray:
        """Of a text with other white space, by runs; whole where it is not certain what white space is."""
        if not self.by_word or _DOUBTFUL.search(text):
            return self._whole(text)
        runs = _RUNS.findall(text)
        missing = list(set(runs).difference(self.runs))
        order, ids, length = self._runs(missing)
        fresh = dict(zip([missing[i] for i in order], np.split(ids, np.cumsum(length)[:-1]), strict=True)) if missing else {}
        if len(self.runs) + len(fresh) <= REMEMBERED_RUNS:
            self.runs.update(fresh)
        return np.concatenate([np.empty(0, self.dtype), *[self.runs[r] if r in self.runs else fresh[r] for r in runs]])

    def _runs(self, runs: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the runs, and in it their ids one after another and how many each has.

        Runs with a space in front are encoded as one text: each begins with the next id that opens with a space.
        """
        joint = [i for i, r in enumerate(runs) if r[0] == " " and len(r) > 1 and r.count(" ") == 1]
        alone = sorted(set(range(len(runs))).difference(joint))
        groups = [joint[at : at + JOINED] for at in range(0, len(joint), JOINED)]
        texts = ["".join([runs[i] for i in some]) for some in groups]
        order, parts, lengths = [], [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for some, encoded in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, self.dtype)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(some):
                alone += some
                continue
            order += some
            parts.append(ids)
            lengths.append(np.diff(np.append(cut, len(ids))))
        single = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast([runs[i] for i in alone], add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, single), np.int64, len(single)))
        return order + alone, np.concatenate(parts + single), np.concatenate(lengths)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so its words are remembered from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tool, shard = encoder(path), TaskContext.get().partitionId()
    bits = bits_for(max(tool.size, END_ID + 1))
    ids: list[np.ndarray] = []
    docs: list[int | None] = []
    size = first = block = 0

    def flush() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        start = (np.cumsum(lengths) - lengths).tolist()
        row = [[shard], [block], [first], [size], [bits], [docs], [start], [pack(np.concatenate(ids), bits)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["shard", "block", "first", "n", "bits", "doc_id", "start", "payload"])

    for batch in batches:
        for a, b, texts in text_chunks(batch, limit=2 << 20):
            names = batch.column(0).slice(a, b - a).to_pylist()
            for doc_id, own in zip(names, tool.encode(texts), strict=True):
                ids.append(np.append(own.astype(np.uint32), np.uint32(END_ID)))
                docs.append(doc_id)
                size += len(own) + 1
                if size >= BLOCK_IDS:
                    yield flush()
                    first, block, size, ids, docs = first + size, block + 1, 0, [], []
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode the texts of ``docs`` (``doc_id``, ``text``) with the tokenizer file and write them to ``path``."""
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", "text").mapInArrow(lambda it: _blocks(it, tokenizer), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``: the ids of all shards before theirs (one row per shard is summed up)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(shards), "shard")


def documents(blocks: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document of ``blocks``, from the unpacked ids."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                b = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(b["payload"], b["bits"], 0, b["n"]).astype("<u4")
                cut = [*b["start"], b["n"]]
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
                start = np.array(b["start"], np.int64) + b["base"] + b["first"]
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(start), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = ["first", "n", "bits", "doc_id", "start", "payload", "base"]
    return blocks.select(*columns).mapInArrow(unpacked, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of the whole stream; reads only the blocks that hold them."""
    at = F.col("base") + F.col("first")
    rows = read_blocks(spark, path).where((at < end) & (at + F.col("n") > begin)).select(at.alias("at"), "n", "bits", "payload").orderBy("at").collect()
    parts = [unpack(r["payload"], r["bits"], max(0, begin - r["at"]), min(r["n"], end - r["at"])) for r in rows]
    return np.concatenate([*parts, np.empty(0, np.uint32)])


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` to the working folder and read every document back."""
    spark = docs.sparkSession
    path = f"{run_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path)
    return documents(read_blocks(spark, path))
