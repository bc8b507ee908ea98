"""Vectorised word splitting and hashing over UTF-8 buffers, for use inside tasks.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``; multi-byte characters
contain no such byte, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit value per byte, from a fixed seed: every task must hash alike.
BYTE_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that a task works on at once.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word of a buffer of bytes."""
    edge = np.diff(np.concatenate(([1], SPACE[data].view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    rising = BYTE_VALUES[data] * _powers(BASE, n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(rising, dtype=np.uint64)))
    falling = _powers(INVERSE, n + 1)
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * falling[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of about ``limit`` bytes with their texts as UTF-8; null counts as empty.

    One text may be longer, none is cut. Only one chunk is copied out of the batch at a time.
    """
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    begin = 0
    while begin < len(size):
        done = total[begin] - size[begin]
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, done + limit, side="right"))))
        yield begin, end, [t or b"" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = spans(data)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    borders = np.concatenate(([0], np.cumsum(sizes)))
    return hash_spans(data, starts, ends), np.searchsorted(starts, borders)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text of fewer words has its whole sequence as its only shingle, one without words none.
    """
    words, first = hashed_words(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(BASE) + words[k : n - width + 1 + k]) if len(rolled) else rolled
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(BASE) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out
