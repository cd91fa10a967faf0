"""Checksums that formats use. CRC tables are made from their polynomials."""

from __future__ import annotations

import binascii
import struct
import zlib
from functools import lru_cache

import numpy as np
import xxhash


@lru_cache(None)
def _table(poly: int) -> list[int]:
    out = []
    for r in range(256):
        for _ in range(8):
            r = (r >> 1) ^ (poly if r & 1 else 0)
        out.append(r)
    return out


STRETCH = 256


@lru_cache(None)
def _stretch(poly: int) -> tuple[np.ndarray, list[list[int]]]:
    """The table as an array, and what STRETCH zero bytes make of each byte of a register."""
    table = _table(poly)
    skip = []
    for byte in range(4):
        row = []
        for v in range(256):
            r = v << 8 * byte
            for _ in range(STRETCH):
                r = (r >> 8) ^ table[r & 0xFF]
            row.append(r)
        skip.append(row)
    return np.array(table, dtype=np.uint32), skip


def _reflected(data: bytes, poly: int, r: int) -> int:
    """A reflected CRC. Long data is cut into stretches whose CRCs are made side by side and then put together: CRCs are linear."""
    table, n = _table(poly), len(data) // STRETCH
    if n >= 96:  # below, one byte after the other is faster
        wide, (a, b, c, d) = _stretch(poly)
        lanes = np.frombuffer(data, np.uint8, n * STRETCH).reshape(n, STRETCH)
        regs = np.zeros(n, dtype=np.uint32)
        for k in range(STRETCH):
            regs = (regs >> np.uint32(8)) ^ wide[(regs ^ lanes[:, k]) & np.uint32(0xFF)]
        for lane in regs.tolist():
            r = a[r & 255] ^ b[r >> 8 & 255] ^ c[r >> 16 & 255] ^ d[r >> 24] ^ lane
        data = data[n * STRETCH :]
    for x in data:
        r = (r >> 8) ^ table[(r ^ x) & 0xFF]
    return r


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def crc32_raw(seed: int, data: bytes) -> int:
    """CRC-32 with a given start and no final complement."""
    return zlib.crc32(data, seed ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32c(data: bytes, seed: int = 0) -> int:
    """Castagnoli; seed is the value so far."""
    return _reflected(data, 0x82F63B78, seed ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32c_raw(seed: int, data: bytes) -> int:
    return _reflected(data, 0x82F63B78, seed)


def crc16(seed: int, data: bytes) -> int:
    """CRC-16/ARC."""
    return _reflected(data, 0xA001, seed)


def crc_itu(data: bytes) -> int:
    """CRC-16 of ITU-T V.41 from 0, as in UDF tags."""
    return binascii.crc_hqx(data, 0)


def fletcher64(data: bytes) -> int:
    """Over little-endian 32-bit words, as APFS objects carry it (the data without the checksum itself)."""
    m, low, high = 0xFFFFFFFF, 0, 0
    words = np.frombuffer(data[: len(data) // 4 * 4], "<u4").astype(np.uint64)
    for at in range(0, len(words), 1024):  # sums of so many fit 64 bits
        w = words[at : at + 1024]
        high = (high + len(w) * low + int((w * np.arange(len(w), 0, -1, dtype=np.uint64)).sum())) % m
        low = (low + int(w.sum())) % m
    c1 = m - (low + high) % m
    c2 = m - (low + c1) % m
    return c2 << 32 | c1


def xxh32(data: bytes) -> int:
    return xxhash.xxh32(data, seed=0).intdigest()


def xxh64(data: bytes) -> int:
    return xxhash.xxh64(data, seed=0).intdigest()


def ones_sum(data: bytes) -> int:
    """The complement of the sum of bytes, 32 bits."""
    return ~sum(data) & 0xFFFFFFFF


def xor16(data: bytes) -> int:
    return int(np.bitwise_xor.reduce(np.frombuffer(data[: len(data) // 2 * 2], "<u2"))) if len(data) > 1 else 0


def rotate_add(data: bytes, skip: tuple[int, ...] = (), bits: int = 32) -> int:
    """Rotate right by one, then add each byte, leaving some positions out."""
    r, mask = 0, (1 << bits) - 1
    for i, b in enumerate(data):
        if i not in skip:
            r = ((r << (bits - 1) | r >> 1) + b) & mask
    return r


def tar_sums(header: bytes) -> tuple[int, int]:
    """The sums of a tar header's bytes, unsigned and signed, its checksum field taken as spaces."""
    h = header[:148] + b" " * 8 + header[156:512]
    return sum(h), sum(b - 256 if b > 127 else b for b in h)
