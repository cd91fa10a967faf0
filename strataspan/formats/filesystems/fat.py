"""FAT12, FAT16 and FAT32: a cluster is in use if any copy of the table says so."""

from __future__ import annotations

import numpy as np

from strataspan.formats.bits import bit_runs
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Short, Source, byte_label, ensure, is_power, le16, le32

STEP = 4 << 20  # entries at a time


def read(p: Source, mode: str, found: Found) -> Usage:
    b = p.upto(0, 512)
    ensure(len(b) == 512, "partition too small for FAT")
    sector, per, reserved, copies, roots = le16(b, 11), b[13], le16(b, 14), b[16], le16(b, 17)
    ensure(is_power(sector) and 512 <= sector <= 4096, "bad bytes per sector")
    ensure(is_power(per), "bad sectors per cluster")
    ensure(reserved and copies, "no reserved sectors or no FAT")
    total, short_len = le16(b, 19) or le32(b, 32), le16(b, 22)
    length = short_len or le32(b, 36)
    ensure(total and length, "empty geometry")
    meta = reserved + copies * length + -(-roots * 32 // sector)
    ensure(total > meta, "no data area")
    clusters = (total - meta) // per
    bits = 32 if not short_len else 12 if clusters < 4085 else 16
    ensure(1 <= clusters <= {12: 4084, 16: 65_524, 32: 0x0FFFFFF5}[bits], "cluster count out of range")
    if bits == 32:
        ensure(roots == 0 and le16(b, 42) == 0, "unknown FAT32 variant")
    else:
        ensure(b[0x36:0x3E] != {12: b"FAT16   ", 16: b"FAT12   "}[bits], "FAT type is ambiguous")
    ensure(length * sector * 8 // bits >= clusters + 2, "FAT too small for the cluster count")
    ensure(total * sector <= p.size, "file system larger than its partition")
    data, cluster, table, one = meta * sector, per * sector, reserved * sector, length * sector
    at = lambda n: data + (n - 2) * cluster
    found.label = _label(p, b, bits, at, cluster, clusters, table + copies * one, data)
    used = [(0, data)]
    entries, bad = clusters + 2, {12: 0xFF7, 16: 0xFFF7, 32: 0x0FFFFFF7}[bits]
    for first in range(0, entries, STEP):
        n = min(STEP, entries - first)
        taken = np.zeros(n, dtype=bool)
        for copy in range(copies):
            v = _entries(p, table + copy * one, bits, first, n)
            taken |= (v != 0) & (v != bad)
        if first == 0:
            taken[:2] = False
        for start, count in bit_runs(np.packbits(taken, bitorder="little").tobytes(), n, first):
            used.append((at(start), at(start + count)))
    return Usage(used, at(clusters + 2), found.label)


def _entries(p: Source, at: int, bits: int, first: int, n: int) -> np.ndarray:
    if bits == 12:  # all of them: there are few
        raw = np.frombuffer(p.read(at, -(-(first + n) * 3 // 2)).ljust(-(-(first + n) * 3 // 2) + 2, b"\0"), np.uint8).astype(np.uint32)
        i = np.arange(first, first + n)
        pair = raw[i + i // 2] | raw[i + i // 2 + 1] << 8
        return np.where(i % 2, pair >> 4, pair & 0xFFF)
    width = bits // 8
    v = np.frombuffer(p.read(at + first * width, n * width), f"<u{width}")
    return v & 0x0FFFFFFF if bits == 32 else v


def _label(p: Source, b: bytes, bits: int, at, cluster: int, clusters: int, root: int, data: int) -> str | None:
    """The root directory's volume entry, else the boot sector's."""
    span = (root, data - root)
    if bits == 32:
        first = le32(b, 44) & 0x0FFFFFFF
        span = (at(first), cluster) if 2 <= first < clusters + 2 else (0, 0)
    try:
        folder = p.read(span[0], min(span[1], 16 << 10)) if span[1] else b""
    except Short:
        folder = b""
    label = None
    for o in range(0, len(folder) - 31, 32):
        e = folder[o : o + 32]
        if e[0] == 0:
            break
        if e[0] != 0xE5 and e[11] != 0x0F and e[11] & 0x18 == 0x08:
            label = byte_label(e[:11])
            break
    mark = 0x42 if bits == 32 else 0x26
    if label is None and b[mark] == 0x29:
        label = byte_label(b[mark + 5 : mark + 16])
    return None if label == "NO NAME" else label
