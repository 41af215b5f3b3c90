"""Words, word hashes and word windows of whole Arrow batches, without a loop per text.

A word is a run of bytes other than space and 0x09-0x0D. All bytes of a UTF-8
character above U+007F are such bytes, so words can be cut on the raw buffers.
Hashes are 64 bits wide: sums of random multiples per byte and position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche, on 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_BYTE = _stream(11, 256)
_BYTE[SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_PLACES = _stream(23, 1 << 12) | U(1)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        _PLACES = _stream(23, 1 << int(n - 1).bit_length()) | U(1)
    return _PLACES


@dataclass
class Words:
    """Words of consecutive texts: byte range, text number and hash of each."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: number of each text's first word; one more entry at the end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True) -> Words:
    """Words of the texts between ``offsets``; A-Z count as a-z if ``lower``."""
    values = _LOWER if lower else _BYTE
    begin, stop = int(offsets[0]), int(offsets[-1])
    starts, ends, sums = [], [], []
    at = begin
    while at < stop:
        to = min(at + PIECE, stop)
        while to < stop and not SPACE[data[to - 1]]:  # a piece ends after a space
            near = SPACE[data[to : to + 4096]]
            hit = int(near.argmax())
            to = to + hit + 1 if near[hit] else min(to + 4096, stop)
        part = data[at:to]
        inside = ~SPACE[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        edge[cuts] = True
        edge[0] = edge[-1] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        s = np.flatnonzero(opens)
        if len(s):
            if hashes:
                width = np.diff(np.append(s, len(part)))
                place = np.arange(s[0], len(part)) - np.repeat(s, width)
                sums.append(np.add.reduceat(values[part[s[0] :]] * _places(int(width.max()))[place], s - s[0]))
            starts.append(s + at)
            ends.append(np.flatnonzero(closes) + 1 + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = mix((np.concatenate(sums) if sums else np.zeros(0, U)) + (end - start).astype(U)) if hashes else np.zeros(0, U)
    return Words(start, end, text, h, first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a window of k words of one text starts, and window hashes."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    place = _places(k)
    total = w.hash[:n] * place[0]
    for j in range(1, k):
        total += w.hash[j : n + j] * place[j]
    at = np.flatnonzero(w.text[:n] == w.text[k - 1 :])
    return at, mix(total[at] + U(k))


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's word sequence, as two 64-bit arrays."""
    n = len(w.first) - 1
    out = np.zeros((2, n), dtype=U)
    if len(w.start):
        place = np.arange(len(w.start)) - np.repeat(w.first[:-1], np.diff(w.first))
        factor = _places(int(place.max()) + 1)[place]
        full = np.flatnonzero(np.diff(w.first))
        for i, h in enumerate((w.hash, mix(w.hash + U(0x5851F42D4C957F2D)))):
            out[i, full] = np.add.reduceat(h * factor, w.first[full])
    count = np.diff(w.first).astype(U)
    return mix(out[0] + count), mix(out[1] + count * U(3))


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts in ``at``."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + k, n), -1)
    return np.cumsum(steps[:-1]) > 0
