"""Vectorised words and word windows of many texts at once (numpy over Arrow's string buffers).

A word is a run of bytes other than ASCII white space. Its 64-bit hash is a polynomial over the bytes (differences
of one prefix sum), finished by a mixing step; a window's hash is the same over its words' hashes. Sums run over chunks of CHUNK
positions, so that a text of any length needs a few bytes of working memory a byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd; 5 mod 8, so that its powers have the largest possible order
CHUNK = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection on 64 bits)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A fixed 64-bit value for every byte.
BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i <= CHUNK."""

    def of(base: int) -> np.ndarray:
        steps = np.full(CHUNK + 1, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i (at most CHUNK values)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers()[0][: len(values)], out=out[1:])
    return out


def _run(data: np.ndarray) -> int:
    """Sum of BYTES[data[i]] * BASE**i over a run of any length."""
    total, step = 0, pow(BASE, CHUNK, 1 << 64)
    for i in reversed(range(0, len(data), CHUNK)):
        total = (total * step + int(_sums(BYTES[data[i : i + CHUNK]])[-1])) % (1 << 64)
    return total


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word data[start:end] (words in order, not overlapping)."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        if end[i] - base > CHUNK:
            out[i] = _run(data[base : end[i]])
        else:
            total = _sums(BYTES[data[base : end[j - 1]]])
            out[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * powers()[1][start[i:j] - base]
        i = j
    return mix(out)


class Words:
    """hash: of every word; start, end: byte range in `data`; first: index of each text's first word, and the total."""

    def __init__(self, strings: pa.Array, lower: bool = False):
        if pa.types.is_large_string(strings.type):
            strings = strings.cast(pa.string())
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        raw = strings.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(data)
        if lower and n:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        self.data, self.offsets = data, offsets
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~SPACES[data]
        opens, closes = edge[:n].copy(), edge[1:].copy()  # a text's edge, or white space beside it, bounds a word
        opens[1:] |= ~inside[:-1]
        closes[:-1] |= ~inside[1:]
        self.start = np.flatnonzero(inside & opens)
        self.end = np.flatnonzero(inside & closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        del edge, inside, opens, closes
        self.hash = word_hashes(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on (fewer positions than words: the last size-1 have none)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n - size + 1, np.uint64), max(1, CHUNK - size)
    if size > CHUNK:  # one window over more words than a chunk holds: its halves' hashes
        half = windows(hashes, size // 2)
        return mix(half[: n - size + 1] * np.uint64(BASE) + windows(hashes[size // 2 :], size - size // 2))
    for i in range(0, len(out), step):
        total = _sums(hashes[i : i + step + size - 1])
        k = len(total) - size
        out[i : i + k] = (total[size:] - total[:-size]) * powers()[1][:k]
    return mix(out + np.uint64(size))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Window positions (over all words of a Words) that stay within one text."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    good = np.ones(n - size + 1, bool)
    for gap in range(1, size):  # a window must not reach over the next text's first word
        at = first[1:-1] - gap
        at = at[(at >= 0) & (at < len(good))]
        good[at] = False
    return np.flatnonzero(good)
