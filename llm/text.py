"""Vectorised word access for text columns inside Arrow tasks.

Words are the maximal runs of bytes other than space and 0x09-0x0D, on the
UTF-8 bytes of the whole text.  A null text has no words.  All functions work
on slices of bounded size, so memory does not depend on the batch Spark sends
(one document larger than a slice is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {b: np.ones(1, np.uint64) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64))}


def powers(n: int) -> list[np.ndarray]:
    """base**0 .. base**n modulo 2**64, and the same of its inverse; kept per worker."""
    for base, have in _powers.items():
        if len(have) <= n:
            grown = np.full(n + 1 + (n >> 3), base, np.uint64)      # an eighth more: slices are of about one size
            grown[0] = 1
            _powers[base] = np.multiply.accumulate(grown)
    return [have[: n + 1] for have in _powers.values()]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[start:end] for every (start, end)."""
    n = len(codes)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive codes (empty if there are fewer)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(n)
    return span_hashes(codes, start, start + width)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their text bytes, byte offsets) in slices of about ``limit`` bytes."""
    text = batch.column(column)
    if pa.types.is_string(text.type) or pa.types.is_binary(text.type):
        text = text.cast(pa.large_binary())
    else:
        text = text.cast(pa.large_string()).cast(pa.large_binary())
    text = text.fill_null(b"")
    if not len(text):
        return
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, len(text))
        yield batch.slice(at, to - at), data[off[at]: off[to]], off[at: to + 1] - off[at]
        at = to


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first word of each document) of the words of a slice.

    ``first`` has one more entry than there are documents: document d owns the
    words first[d] .. first[d + 1] - 1.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_WHITE[data]
    opens = inside[1:] & ~inside[:-1]      # at byte i: a word starts
    closes = inside[:-1] & ~inside[1:]     # at byte i: a word ended just before
    edges = off[1:-1]
    if len(edges):                         # a word never crosses documents
        joined = edges[inside[edges + 1] & inside[edges]] if n else edges[:0]
        opens[joined] = True
        closes[joined] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    codes = _BYTE_CODE[_LOWER[data] if lower else data]
    hashes = span_hashes(codes, start, end) if len(start) else np.zeros(0, np.uint64)
    return start, end, hashes, np.searchsorted(start, off, side="left")
