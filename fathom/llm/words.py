"""Vectorised words, shingles and hashes over Arrow string batches.

A word is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``; ``A-Z`` count as
lower case.  Every function works on the raw UTF-8 buffer of a batch, so no Python object
is made per word.  Batches are cut into pieces of about ``PIECE`` bytes first, which bounds
the memory of a task by the longest single text rather than by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE_VALUE[_LOWER]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
#: Letters, digits and every byte of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(2 * n, 1 << 16), base, np.uint64)
        steps[0] = _ONE
        have = np.multiply.accumulate(steps)
        if n <= 4 * PIECE:
            _powers[name] = have
    return have[:n]


class Text(NamedTuple):
    """Bytes of several texts; text i lies in ``data[starts[i]:starts[i + 1]]``."""

    first: int
    data: np.ndarray
    starts: np.ndarray


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Text]:
    """Cut a string column (null: empty) into runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield Text(row, raw[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


class Words(NamedTuple):
    """Word k is ``data[begin[k]:end[k]]``; words of text i are ``first[i]:first[i + 1]``."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def prefix_hash(data: np.ndarray, fold_case: bool) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` takes any span out of it."""
    values = (_BYTE_LOWER if fold_case else _BYTE_VALUE)[data]
    values *= _power("up", _BASE, len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _power("down", _BASE_INV, len(prefix))
    return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MUL)


def words(text: Text, fold_case: bool = True, table: np.ndarray = _IS_WORD) -> Words:
    """Words of each text: runs of bytes that ``table`` marks, never across texts."""
    inside = table[text.data]
    edge = np.zeros(len(text.data) + 1, bool)
    edge[text.starts] = True
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    begin = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    found = span_hash(prefix_hash(text.data, fold_case), begin, end) if len(begin) else np.zeros(0, np.uint64)
    return Words(begin, end, np.searchsorted(begin, text.starts), found)


def shingles(found: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, and where each text's hashes begin.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    count = np.diff(found.first)
    n = len(found.hash)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | _ONE
    summed = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        if len(summed):
            summed += found.hash[k : n - size + 1 + k] * weights[k]
    full = np.maximum(count - size + 1, 0)
    short = (count > 0) & (count < size)
    out_n = full + short
    first = np.zeros(len(out_n) + 1, np.int64)
    np.cumsum(out_n, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    owner = np.repeat(np.arange(len(full)), full)
    if len(owner):
        within = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        out[first[owner] + within] = mix(summed[found.first[owner] + within] + np.uint64(size))
    for i in np.flatnonzero(short):
        own = found.hash[found.first[i] : found.first[i + 1]]
        out[first[i]] = mix((own * weights[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, first
