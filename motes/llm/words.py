"""Words of many texts at once, on bytes: where they lie, and hashes of words and of word shingles."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Bytes hashed together; a word longer than half of this is hashed on its own.
SEGMENT = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                   0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C06FAF4D023E3AB], np.uint64)


def bounds(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest stretch of bytes that ``inside`` (a table of 256) marks."""
    mark = np.zeros(len(buf) + 2, bool)
    np.take(inside, buf, out=mark[1:-1])
    edges = np.flatnonzero(mark[1:] != mark[:-1])
    return edges[::2], edges[1::2]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(b: int) -> np.ndarray:
        out = np.full(SEGMENT + 1, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)
    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes, whatever stands around them."""
    up, down = _powers()
    out = np.zeros(len(start), np.uint64)
    size = end - start
    k = 0
    while k < len(start):
        base = int(start[k])
        to = max(k + 1, int(np.searchsorted(start, base + SEGMENT // 2)))
        last = int(end[to - 1])
        if last - base > SEGMENT:  # its last word is a giant
            to -= to > k + 1
            last = int(end[to - 1])
        if last - base > SEGMENT:
            out[k] = np.frombuffer(hashlib.blake2b(buf[base:last].tobytes(), digest_size=8).digest(), np.uint64)[0]
        else:
            sums = np.zeros(last - base + 1, np.uint64)
            np.cumsum((buf[base:last].astype(np.uint64) + np.uint64(1)) * up[:last - base], out=sums[1:])
            s, e = start[k:to] - base, end[k:to] - base
            out[k:to] = (sums[e] - sums[s]) * down[s]
        k = to
    return _mixed(out + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words that follow each other, by the first of them."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h += words[j:j + n] * _STEPS[j]
    return _mixed(h)
