"""Words and their 64-bit hashes for whole Arrow columns, without a Python loop over words.

A word is a run of characters other than the six ASCII white-space ones, after lower-casing A to Z. Both rules only
touch ASCII, so they hold on UTF-8 bytes. A word's hash is a polynomial over its bytes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over all others."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    first: int  # row of the column at which this block of documents starts
    count: np.ndarray  # words of each document
    at: np.ndarray  # len(count) + 1 bounds into hash
    hash: np.ndarray  # uint64 of each word


def blocks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Words]:
    """The documents of a string column in blocks of about most_bytes (a longer document is a block of its own)."""
    column = column.fill_null("")
    if len(column) == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most_bytes, side="right")) - 1)
        yield _hashed(i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def _hashed(first: int, text: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(text)
    if n == 0:
        none = np.zeros(len(bounds) - 1, dtype=np.int64)
        return Words(first, none, np.zeros(len(bounds), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    inside = ~_SPACE[text]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    begin[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[text] * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    at = np.searchsorted(start, bounds).astype(np.int64)
    return Words(first, np.diff(at), at, value)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one document in order; of a shorter one, of its whole sequence; none of none."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * U(0x9FB21C651E98DF25) + words[k : len(words) - width + 1 + k]
    return mix(out)
