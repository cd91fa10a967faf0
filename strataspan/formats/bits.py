"""Runs of set bits, by NumPy."""

from __future__ import annotations

import numpy as np


def bit_runs(data: bytes, bits: int, base: int = 0, msb_first: bool = False, invert: bool = False) -> list[tuple[int, int]]:
    """(first, count) of the runs of set bits among the first `bits`, numbered from base; with invert those of clear bits. Bits that
    data doesn't have count as clear."""
    have = min(bits, 8 * len(data))
    b = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="big" if msb_first else "little")[:have]
    if have < bits:
        b = np.concatenate([b, np.zeros(bits - have, np.uint8)])
    if invert:
        b = 1 - b
    edge = np.flatnonzero(np.diff(np.concatenate([[0], b, [0]]).astype(np.int8)))
    return [(base + int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def popcount(data: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(data, np.uint8)).sum())


def merge(ranges: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Ranges (start, end) that touch, overlap or lie less than gap apart, united: for the few of one file system."""
    out: list[list[int]] = []
    for s, e in sorted(r for r in ranges if r[0] < r[1]):
        if out and (s <= out[-1][1] or s - out[-1][1] < gap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def complement(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for s, e in merge(ranges):
        if s > at:
            out.append((at, min(s, size)))
        at = max(at, e)
    if at < size:
        out.append((at, size))
    return [(s, e) for s, e in out if s < e]
