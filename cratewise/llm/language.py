"""Language identification with a string kernel.

The kernel of two texts is the share of n-grams of 1 to 4 characters that both have (a blended
spectrum of presences), normalised to 1 for equal texts. A few training texts are landmarks: the
Nystroem method turns kernel values with them into coordinates, and one ridge regression per language
is fitted on these. A batch of texts is scored by two matrix products: presences with the landmarks'
presences, and the result with the classifiers.

n-grams live in ``BUCKETS`` hash buckets, so a text is one row of bits whatever its length. Texts are
lower-cased and everything but letters becomes one space.

Fitted in the driver on at most ``per_language`` texts of each language, those with the smallest hash
of their id. Defined results: a null text, or one without a letter, is ``und`` with score 0; without
training texts all are; whole texts are read; repeated rows are predicted separately; rows without an
id or a language are never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.words import mix, text_chunks

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
PER_LANGUAGE, LANDMARKS = 250, 40
RIDGE = 1e-2
#: Texts that are scored in one product.
ROWS = 64
_SPACE = np.uint32(32)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space; letters whose lower case is longer stay."""
    if not _TABLE:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def presences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 per text: which buckets its n-grams fill; and whether it has a letter."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    lettered = np.zeros(len(texts), bool)
    table = _letters()
    for r, text in enumerate(texts):
        points = table[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
        keep = points != _SPACE
        if not keep.any():
            continue
        lettered[r] = True
        keep |= np.concatenate((keep[1:], [False]))  # of a run of spaces before a letter the last one
        inner = points[keep]
        x = np.concatenate(([_SPACE], inner[int(inner[0] == _SPACE) :], [_SPACE])).astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = mix(h[: len(x) - n + 1] * np.uint64(31) + x[n - 1 :] + np.uint64(n << 40))
            if n in ORDERS:
                out[r, (h % np.uint64(BUCKETS)).astype(np.int64)] = 1
    return out, lettered


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # transposed presences, each by the root of its number
    coordinates: np.ndarray  # kernel values to Nystroem coordinates
    weights: np.ndarray  # one column per language, the bias last

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bits, lettered = presences(texts)
        kernel = (bits @ self.landmarks) / np.sqrt(np.maximum(1, bits.sum(1, keepdims=True)))
        points = kernel @ self.coordinates
        return points @ self.weights[:-1] + self.weights[-1], lettered


def fit(texts: list[bytes], langs: list[str]) -> Model | None:
    """Landmarks are the first ``LANDMARKS`` texts of each language."""
    names = sorted(set(langs))
    if not names:
        return None
    taken = {n: 0 for n in names}
    chosen = []
    for i, lang in enumerate(langs):
        taken[lang] += 1
        if taken[lang] <= LANDMARKS:
            chosen.append(i)
    bits, lettered = presences([texts[i] for i in chosen])
    bits = bits[lettered]
    if not len(bits):
        return None
    marks = (bits / np.sqrt(bits.sum(1, keepdims=True))).T
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    coordinates = vectors[:, good] / np.sqrt(values[good])
    rows, kept = [], []
    for at in range(0, len(texts), ROWS):
        part, has = presences(texts[at : at + ROWS])
        rows.append(((part @ marks) / np.sqrt(np.maximum(1, part.sum(1, keepdims=True))))[has] @ coordinates)
        kept += [langs[at + int(i)] for i in np.flatnonzero(has)]
    x = np.concatenate(rows)
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    y = np.where(np.array(kept)[:, None] == np.array(names)[None, :], 1.0, 0.0)
    penalty = RIDGE * len(x) / 100 * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    return Model(names, marks.astype(np.float32), coordinates.astype(np.float32), weights.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the rows of ``docs`` that are not held out and have a language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).where("text IS NOT NULL")
    rows = sorted((r["lang"], r["nth"], r["text"]) for r in sample.collect())  # per_language texts of each language
    return fit([r[2].encode() for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``docs`` (``doc_id``, ``text``)."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch, rows=ROWS):
                if model is None:
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    scores, lettered = model.scores(texts)
                    best = scores.argmax(1)
                    lang = [model.langs[k] if x else "und" for k, x in zip(best, lettered, strict=True)]
                    score = np.where(lettered, np.clip(scores.max(1), 0, 1), 0).astype(np.float64)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predicted, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from ``docs`` (``doc_id``, ``lang``, ``text``) and predict each of its rows."""
    return identify(docs, train(docs, per_language))
