"""Quality rules by distribution divergence.

Base counts fail texts that are too short or repeat themselves. Of the others, the histogram of
character classes and the histogram of common words are compared with those of each language by
Jensen-Shannon distance; a text is kept if some language is near enough in both. Character classes are
compared for every text that passes the base; words only from ``GUARD_WORDS`` words on, as the histogram
of fewer says little, and the language nearest by characters alone counts below that.

A language's reference is counted over all texts of that language. Words are counted in ``BUCKETS``
hash buckets, so the counts of a task are of one size whatever the text; the ``COMMON`` fullest
buckets are the language's common words and the rest is one more bin.

Defined results: null and empty texts have no words and fail; whole texts are counted; texts without a
language count for no reference, and without any reference nothing is rejected by divergence; repeated
rows are judged separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.words import SPACE, hash_spans, mix, spans, text_chunks

BUCKETS, COMMON = 4096, 64
MIN_WORDS, MAX_REPEATED = 20, 30
#: The words of shorter texts are not compared with the references.
GUARD_WORDS = 50
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.45
WINDOW = 8
#: Character classes; other ASCII marks are class 0, bytes of other characters class 1.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:", "!?", "#*$%&|<>", "\"'()[]{}-"]
CLASS = np.zeros(256, np.int64)
CLASS[128:] = 1
for _k, _group in enumerate(CLASSES):
    CLASS[[ord(c) for c in _group]] = _k + 2
N_CLASSES = len(CLASSES) + 2
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Counted:
    """Counts of a few texts: whole-buffer arrays and the texts' borders in them."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts, self.ends = spans(self.data)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.borders = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.borders)
        self.n_words = np.diff(self.first)
        self.of_word = np.repeat(np.arange(self.n), self.n_words)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of a buffer's bytes are marked, by text (without the joining line end)."""
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[self.borders[1:] - 1] - total[self.borders[:-1]]

    def classes(self) -> np.ndarray:
        of_byte = np.repeat(np.arange(self.n), np.diff(self.borders))
        counts = np.bincount(of_byte * N_CLASSES + CLASS[self.data], minlength=self.n * N_CLASSES).reshape(self.n, N_CLASSES)
        counts[:, CLASS[10]] -= 1  # the joining line end
        return counts

    def buckets(self) -> np.ndarray:
        """The bucket of every word, lower-cased."""
        low = np.frombuffer(self.data.tobytes().lower(), np.uint8)
        return (hash_spans(low, self.starts, self.ends) % np.uint64(BUCKETS)).astype(np.int64)

    def repeated_words(self) -> np.ndarray:
        """Words in windows that a text has twice or more."""
        words = hash_spans(self.data, self.starts, self.ends)
        n = len(words) - WINDOW + 1
        if n <= 0:
            return np.zeros(self.n, np.int64)
        rolled = mix(self.of_word[:n].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            rolled = mix(rolled + words[k : k + n])
        inside = np.flatnonzero(self.of_word[:n] == self.of_word[WINDOW - 1 :])
        order = inside[np.argsort(rolled[inside], kind="stable")]
        same = rolled[order][1:] == rolled[order][:-1]
        twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + WINDOW, -1)
        total = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        filled = np.concatenate(([0], np.cumsum(~SPACE[self.data])))
        real = filled[ends] > filled[starts]
        of_line = np.searchsorted(self.borders, starts, side="right") - 1
        key = hash_spans(self.data, starts, ends)[real]
        of_line = of_line[real]
        order = np.lexsort((key, of_line))
        key, of_line = key[order], of_line[order]
        again = (key[1:] == key[:-1]) & (of_line[1:] == of_line[:-1])
        return np.bincount(of_line[1:][again], minlength=self.n)


@dataclass
class References:
    """Per language: shares of character classes, its common buckets and their shares with the rest last."""

    chars: np.ndarray
    common: np.ndarray
    words: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b, texts in text_chunks(batch):
            lang = batch.column(0).slice(a, b - a).to_pylist()
            known = sorted(set(lang))
            code = np.searchsorted(known, lang)
            c = Counted(texts)
            chars = c.classes()
            width = len(known) * BUCKETS
            words = np.bincount(code[c.of_word] * BUCKETS + c.buckets(), minlength=width).reshape(len(known), BUCKETS)
            for k, name in enumerate(known):
                own = np.concatenate((chars[code == k].sum(0), words[k]))
                total[name] = total.get(name, 0) + own
    names = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x] for x in names], pa.list_(pa.int64()))], names=["lang", "counts"])


def references(docs: DataFrame) -> References:
    """References of all languages of ``docs`` (``lang``, ``text``), over all of its rows."""
    counts = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, counts array<bigint>")
    summed = counts.select("lang", F.posexplode("counts").alias("bin", "c")).groupBy("lang", "bin").agg(F.sum("c").alias("c"))
    rows = summed.groupBy("lang").agg(F.collect_list(F.struct("bin", "c")).alias("bins")).collect()  # BUCKETS bins of each language
    full = np.zeros((len(rows), N_CLASSES + BUCKETS))
    for k, r in enumerate(sorted(rows, key=lambda r: r["lang"])):
        for x in r["bins"]:
            full[k, x["bin"]] = x["c"]
    full = full[full[:, :N_CLASSES].sum(1) > 0]
    words = full[:, N_CLASSES:]
    common = np.argsort(-words, axis=1, kind="stable")[:, :COMMON]
    share = np.take_along_axis(words, common, 1)
    share = np.concatenate((share, words.sum(1, keepdims=True) - share.sum(1, keepdims=True)), 1)
    return References(_shares(full[:, :N_CLASSES]), common, _shares(share))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(1, counts.sum(-1, keepdims=True))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def distances(counted: Counted, ref: References) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each text to the reference that is nearest in sum: by characters, by words."""
    chars, buckets = _shares(counted.classes()), counted.buckets()
    by_char, by_word = [], []
    for k in range(len(ref.chars)):
        by_char.append(js_distance(chars, ref.chars[k]))
        place = np.full(BUCKETS, COMMON)
        place[ref.common[k]] = np.arange(ref.common.shape[1])
        bins = np.bincount(counted.of_word * (COMMON + 1) + place[buckets], minlength=counted.n * (COMMON + 1))
        by_word.append(js_distance(_shares(bins.reshape(counted.n, COMMON + 1)), ref.words[k]))
    if not by_char:
        return np.zeros(counted.n), np.zeros(counted.n)
    by_char, by_word = np.array(by_char), np.array(by_word)
    nearest = np.argmin(by_char + np.where(counted.n_words < GUARD_WORDS, 0, by_word), axis=0)
    at = np.arange(counted.n)
    return by_char[nearest, at], by_word[nearest, at]


RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_js double, word_js double"


def quality_rules(docs: DataFrame, ref: References) -> DataFrame:
    """The columns of ``RESULT`` per row of ``docs`` (``doc_id``, ``text``)."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                c = Counted(texts)
                point = (c.data & 0xC0) != 0x80  # first byte of a character
                repeat = c.repeated_words()
                failed = (c.n_words < MIN_WORDS) | (100 * repeat > MAX_REPEATED * c.n_words)
                chars, words = distances(c, ref)
                near = (chars <= CHAR_LIMIT) & ((c.n_words < GUARD_WORDS) | (words <= WORD_LIMIT))
                columns = [c.n_words, c.per_text(point & ~SPACE[c.data]), c.per_text(SYMBOL[c.data]), c.repeated_lines(), repeat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(x, pa.int64()) for x in columns], pa.array(failed), pa.array(~failed & near), pa.array(chars), pa.array(words)],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(judged, RESULT)


def apply_rules(docs: DataFrame) -> DataFrame:
    """Rules against references that are counted over ``docs`` itself (``doc_id``, ``lang``, ``text``)."""
    return quality_rules(docs, references(docs))
