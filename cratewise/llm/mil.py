"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its characters
and words, a gated attention weighs the encodings, and their weighted sum gives the document's
score. Only document labels are learned from; the text is the only input of a score.

The classifier is fitted in the driver on at most ``max_docs`` labelled documents, those with the
smallest hash of their id; everything else is done in tasks, chunk by chunk.

Defined results: null, empty and blank texts are one empty passage and get a score; whole texts are
scored, however long; repeated rows are scored separately; rows with a null id are never learned
from; without labels every score is 0.5; other columns are ignored (or kept by ``with_score``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from cratewise.llm.columns import spare
from cratewise.llm.words import hash_spans, spans, text_chunks

PASSAGE = 64
MAX_DOCS = 4000
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY, BATCH = 60, 0.01, 1e-4, 256
THRESHOLD = 0.7
BUCKETS = 24

#: Character classes: each byte has one. Other ASCII marks are 0, bytes of other characters 1.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "#", "*", "$", "%", "&", "|", "<>", "\"'", "()[]{}"]
CLASS = np.zeros(256, np.int64)
CLASS[128:] = 1
for _k, _group in enumerate(GROUPS):
    CLASS[[ord(c) for c in _group]] = _k + 2
N_CLASSES = len(GROUPS) + 2
N_FEATURES = N_CLASSES + 5 + BUCKETS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts in order, and each text's number of passages (at least 1)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = spans(data)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    n = np.diff(first)
    bags = np.maximum(1, -(-n // PASSAGE))
    begin = np.cumsum(bags) - bags
    of_word = np.repeat(begin, n) + (np.arange(len(starts)) - np.repeat(first[:-1], n)) // PASSAGE
    total = int(bags.sum())
    count = np.bincount(of_word, minlength=total)
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, bags
    # a word's bytes and the white space after it, within its text
    follow = np.minimum(np.append(starts[1:], len(data)), np.repeat(np.cumsum(sizes) - 1, n))
    width = follow - starts
    of_byte = np.repeat(of_word, width)
    at = np.arange(len(of_byte)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(starts, width)
    counts = np.bincount(of_byte * N_CLASSES + CLASS[data[at]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    words = hash_spans(data, starts, ends)
    many = np.maximum(1, count)
    order = np.lexsort((words, of_word))
    w, p = words[order], of_word[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])))
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])))
    last = data[ends - 1]
    k = N_CLASSES
    out[:, k] = np.bincount(p[new], minlength=total) / many
    out[:, k + 1] = np.bincount(of_word[again], minlength=total) / many
    out[:, k + 2] = np.bincount(of_word, ends - starts, minlength=total) / many / 10
    out[:, k + 3] = np.bincount(of_word[(CLASS[last] != 2) & (CLASS[last] > 3)], minlength=total) / many
    out[:, k + 4] = np.log1p(count) / 5
    hashed = np.bincount(of_word * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, k + 5 :] = hashed / many[:, None]
    return out, bags


@dataclass
class Model:
    """Gated-attention network over standardised passage features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    flat: bool = False

    def score(self, features: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(bags), 0.5)
        logit = forward(self.weights, (features - self.mean) / self.scale, bags)[0]
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -40, 40)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
    begin = np.cumsum(bags) - bags
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (t * g) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, begin), bags))
    a = s / np.repeat(np.add.reduceat(s, begin), bags)
    z = np.add.reduceat(h * a[:, None], begin)
    return z @ w["c"] + w["b"][0], (h, t, g, a, z)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    logit, (h, t, g, a, z) = forward(w, x, bags)
    d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"], bags, axis=0)
    inner = (dz * h).sum(1)
    ds = a * (inner - np.repeat(np.add.reduceat(a * inner, np.cumsum(bags) - bags), bags))
    dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
    dh = dz * a[:, None] + dt @ w["V"].T + dg @ w["U"].T
    de = dh * (1 - h * h)
    return {"E": x.T @ de, "e": de.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}


def fit(features: np.ndarray, bags: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam over shuffled mini-batches of documents, with a fixed seed."""
    if not len(labels):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, flat=True)
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x, begin = ((features - mean) / scale).astype(np.float64), np.cumsum(bags) - bags
    shape = {"E": (N_FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(v[0]), v) if k not in "eb" else np.zeros(v) for k, v in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(begin[d], begin[d] + bags[d]) for d in some])
            grad = _gradients(w, x[rows], bags[some], labels[some])
            step += 1
            for k in w:
                full = grad[k] + DECAY * w[k] * (k not in "eb")
                m[k] = 0.9 * m[k] + 0.1 * full
                v[k] = 0.999 * v[k] + 0.001 * full**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model of ``labels.quality`` from documents that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    # in the order of a hash, and of the id where hashes tie
    chosen = usable.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(_bags, "doc_id bigint, quality int, n int, features binary")
    rows = bags.collect()  # at most max_docs labelled documents
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    if not rows:
        return fit(np.empty((0, N_FEATURES)), np.empty(0, np.int64), np.empty(0))
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows])
    return fit(features, np.array([r["n"] for r in rows]), np.array([float(r["quality"]) for r in rows]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_chunks(batch):
            features, bags = passages(texts)
            cut = np.cumsum(bags)
            blobs = [features[e - n : e].tobytes() for e, n in zip(cut, bags, strict=True)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(bags, pa.int32()), pa.array(blobs)], names=["doc_id", "quality", "n", "features"])


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of the scores of its ``text``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                part = batch.slice(a, b - a)
                score = model.score(*passages(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields]).add(name, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs`` (``doc_id``, ``text``)."""
    scored = with_score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs, labels, max_docs))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    (score,) = spare(docs, "_score")
    return with_score(docs, train(docs, labels), score).where(F.col(score) >= THRESHOLD).drop(score)
