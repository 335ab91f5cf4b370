"""Vectorised 64-bit hashes of words and word shingles over whole Arrow columns.

Words are runs of bytes outside a separator set. No Python loop runs over words or bytes: word
edges come from one table lookup, word hashes from 8-byte lanes, shingles from shifted folds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M1, _M2, _LEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one, so that a text without spaces takes no lane loop.
_LONG = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text bytes of a string column and each row's offsets there; nulls hold nothing."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, A-Z lower-cased, and the index of each row's first word.

    Returns ``(hashes, first)`` where row ``i`` has ``hashes[first[i]:first[i + 1]]``.
    """
    raw, at = _bytes_of(column)
    rows = len(at) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    low = LOWER[raw]
    inside = ~separators[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    lanes = np.ndarray((len(low) + 1,), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(U) * _LEN)
        todo = np.arange(len(start))
        for done in range(0, _LONG, 8):
            todo = todo[size[todo] > done]
            if not len(todo):
                break
            lane = lanes[start[todo] + done]
            spare = np.maximum(0, 8 - (size[todo] - done)).astype(U) * U(8)
            h[todo] = mix(h[todo] ^ ((lane << spare) + _LEN))
        for i in np.flatnonzero(size > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(low[start[i] : end[i]].tobytes())
    return h, np.searchsorted(start, at).astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the word shingles of one text, in order; a text of fewer than k words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, U(width), U)
        for i in range(width):
            out = mix((out ^ words[i : n - width + 1 + i]) + _LEN)
    return out
