"""Hashes of words and word shingles, for a batch of texts at a time in NumPy.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case. All hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _STEP, np.uint64))])
    return _powers[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds): words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    white = _WHITE[buf]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    at = np.cumsum([1, *(len(r) + 1 for r in raw)])
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    length = ends - starts
    first = np.cumsum(length) - length
    within = np.arange(length.sum()) - np.repeat(first, length)
    body = _BYTE[buf[~white]] * _power(int(length.max()) + 1)[within]
    return mix(np.add.reduceat(body, first) + length.astype(np.uint64)), bounds


def batches(texts: list[str | None], most: int = 1 << 19) -> Iterator[slice]:
    """Slices of the list with about `most` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; with fewer words the whole sequence as one, without
    words none."""
    for part in batches(texts):
        words, bounds = word_hashes(texts[part])
        m = len(words) - n + 1
        if m > 0:
            joined = words[:m].copy()
            for k in range(1, n):
                joined = mix(joined * _STEP + words[k : k + m])
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= n:
                yield np.unique(joined[a : b - n + 1])
            elif b > a:
                h = words[a : a + 1].copy()
                for k in range(1, b - a):
                    h = mix(h * _STEP + words[a + k : a + k + 1])
                yield mix(h + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
