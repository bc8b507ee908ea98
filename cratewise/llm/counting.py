"""Token counts of whole texts, encoded in batches of bounded bytes; only lengths leave a batch.

A task takes its texts in batches of about ``BATCH_BYTES``. A text above ``SPLIT_BYTES`` is first cut at safe
boundaries: places between two characters that stand next to each other in no piece of the vocabulary.
A merge across such a place would make a piece that has both, so the parts are encoded independently.
The model puts a mark before every text it is given; parts after the first are given behind a line
end, which no piece contains, and the tokens of that are taken off again.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of control tokens inside a
text are ordinary text, as the library's default is; a text without a safe boundary is encoded whole; repeated
rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cratewise.llm.words import text_chunks

LIMIT_TOKENS = 4096
BATCH_BYTES, SPLIT_BYTES = 1 << 20, 1 << 14
#: How the model writes a space.
SPACE_MARK = "▁"


class PieceCounter:
    """Token counts by a sentencepiece model."""

    def __init__(self, path: str, split_bytes: int = SPLIT_BYTES):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.split_bytes = split_bytes
        ids = range(self.library.vocab_size())
        pieces = [self.library.id_to_piece(i) for i in ids if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.joined = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        # both hold for models that leave texts as they are and know no line end; others take texts whole
        odd = "aﬁ①\t  \r\n b"
        unchanged = self.library.normalize(odd).lstrip(SPACE_MARK) == odd.replace(" ", SPACE_MARK)
        self.splits = unchanged and not any("\n" in piece for piece in pieces)
        self.line_end = len(self.library.encode("\n"))

    def parts(self, text: bytes) -> list[str] | list[bytes]:
        """The text cut at safe boundaries; every part after the first begins with a line end."""
        if len(text) <= self.split_bytes or not self.splits:
            return [text]
        whole = text.decode()
        marked = whole.replace(" ", SPACE_MARK)
        out, begin, size = [], 0, self.split_bytes // 2
        while begin < len(whole):
            end = begin + size
            while end < len(whole) and marked[end - 1 : end + 1] in self.joined:
                end += 1
            out.append(whole[begin:end] if not begin else "\n" + whole[begin:end])
            begin = end
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of every text."""
        parts = [self.parts(t) for t in texts]
        lengths = map(len, self.library.encode([p for own in parts for p in own], num_threads=1))
        return [sum(next(lengths) for _ in own) - (len(own) - 1) * self.line_end for own in parts]


class JsonCounter:
    """Token counts by a file of the tokenizers library; texts are given whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


_COUNTERS: dict[str, PieceCounter | JsonCounter] = {}


def counter(path: str) -> PieceCounter | JsonCounter:
    """One per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = JsonCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT_TOKENS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs`` (``doc_id``, ``text``); no shuffle."""
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in batches:
            for a, b, texts in text_chunks(batch, limit=batch_bytes):
                tokens = tool.count(texts)
                columns = [batch.column(0).slice(a, b - a), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(counted, StructType([chosen.schema["doc_id"], *fields]))
