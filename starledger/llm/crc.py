"""CRC-32 of all word n-grams of whole Arrow columns, without a Python loop over words.

The CRC of ``a + b`` follows from those of ``a`` and ``b`` and the length of ``b``: the register is linear,
so zero bytes are run through it by table. Words are runs of bytes outside a separator set, A-Z lower-cased.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from .hashing import LOWER, NOT_ALNUM, _bytes_of

U = np.uint32
FULL = U(0xFFFFFFFF)
#: Longer words are summed one by one.
_LONG = 256


def _byte_table() -> np.ndarray:
    """The register after each byte, by the polynomial of CRC-32."""
    out = np.arange(256, dtype=U)
    for _ in range(8):
        out = np.where(out & U(1), (out >> U(1)) ^ U(0xEDB88320), out >> U(1)).astype(U)
    return out


BYTE = _byte_table()


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values for each of the four bytes."""
    return tables[0][x & U(255)] ^ tables[1][(x >> U(8)) & U(255)] ^ tables[2][(x >> U(16)) & U(255)] ^ tables[3][x >> U(24)]


def _zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps for 0 to 63 zero bytes, and for 64, 128, 256, ... of them."""
    each = np.stack([np.arange(256, dtype=U) << U(8 * i) for i in range(4)])
    few = [each]
    for _ in range(64):
        each = BYTE[each & U(255)] ^ (each >> U(8))
        few.append(each)
    powers = [few.pop()]
    while len(powers) < 26:
        powers.append(np.stack([_through(powers[-1], t) for t in powers[-1]]))
    return np.stack(few), powers


FEW, POWERS = _zeros()
_FLAT = FEW.reshape(-1)


def _run_zeros(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each."""
    at = (count & 63).astype(np.int64) * 1024
    out = _FLAT[at + (x & U(255))] ^ _FLAT[at + 256 + ((x >> U(8)) & U(255))] ^ _FLAT[at + 512 + ((x >> U(16)) & U(255))] ^ _FLAT[at + 768 + (x >> U(24))]
    high = count >> 6
    for bit, tables in enumerate(POWERS):
        if not high.any():
            break
        odd = np.flatnonzero(high & 1)
        out[odd] = _through(tables, out[odd])
        high = high >> 1
    return out


def word_spans(column: pa.Array, separators: np.ndarray = NOT_ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all rows, each word's first byte and the byte after it, and each row's first byte."""
    raw, at = _bytes_of(column)
    low = LOWER[raw]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = ~separators[low]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edge = at[1:-1]
    edge = edge[inside[edge] & inside[edge + 1]]  # a row that ends in a word, before one that begins with one
    begins[edge] = ends[edge] = True
    return low, np.flatnonzero(begins), np.flatnonzero(ends), at


def gram_sums(column: pa.Array, n: int, own: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The CRCs of all runs of 1 to ``n`` words of each row, joined by one space.

    Returns, by run length, the sums and the index of each row's first, and the number of words by row. With
    ``own``, only runs that begin within a row's first so many bytes count; words beyond can end them.
    """
    low, start, end, at = word_spans(column)
    size = end - start
    state = np.full(len(start), FULL)
    todo = np.arange(len(start))
    for i in range(_LONG):
        todo = todo[size[todo] > i]
        if not len(todo):
            break
        x = state[todo]
        state[todo] = BYTE[(x ^ low[start[todo] + i]) & U(255)] ^ (x >> U(8))
    for i in np.flatnonzero(size > _LONG):
        state[i] = U(zlib.crc32(low[start[i] : end[i]].tobytes())) ^ FULL
    first = np.searchsorted(start, at).astype(np.int64)
    last = first[1:] if own is None else np.minimum(first[1:], np.searchsorted(start, at[:-1] + own))
    row_end = np.repeat(first[1:], np.diff(first))
    owned = np.arange(len(start)) < np.repeat(last, np.diff(first))
    sums, firsts, run, at_word = [], [], state, np.flatnonzero(owned)
    run = state[at_word]
    for length in range(1, n + 1):
        if length > 1:
            fits = at_word + length - 1 < row_end[at_word]
            at_word, run = at_word[fits], run[fits]
            nxt = at_word + length - 1
            run = BYTE[(run ^ U(32)) & U(255)] ^ (run >> U(8))
            run = _run_zeros(run ^ FULL, size[nxt]) ^ state[nxt]
        sums.append(run ^ FULL)
        firsts.append(np.searchsorted(at_word, first))
    return sums, firsts, last - first[:-1]
