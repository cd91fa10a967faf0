"""HFS+ and HFSX: the allocation bitmap (highest bit first), the special files and all extents that overflow, and the journal; also
inside an HFS wrapper, which is kept as it is."""

from __future__ import annotations

from strataspan.formats.bits import bit_runs, popcount
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Bad, Short, Source, be16, be32, be64, ensure, is_power, le32, le64

UNMOUNTED, INCONSISTENT, JOURNALED = 1 << 8, 1 << 11 | 1 << 14, 1 << 13
#: Magics and byte-order mark of a journal, and the file number of the bitmap.
JOURNAL, OLD_JOURNAL, ORDER, BITMAP = 0x4A4E4C78, 0x4A484452, 0x12345678, 6
STEP = 4 << 20


def signed(b: bytes, at: int) -> bool:
    return (b[at : at + 2], be16(b, at + 2)) in ((b"H+", 4), (b"HX", 5))


def embeds(h: bytes) -> bool:
    return h[1024:1026] == b"BD" and h[1024 + 0x7C : 1024 + 0x7E] in (b"H+", b"HX")


class _Volume:
    def __init__(self, p: Source, at: int, room: int):
        self.p, self.start = p, at
        h = p.read(at + 1024, 512)
        ensure(signed(h, 0), "no HFS+ volume header in the wrapper")
        self.header, self.block, self.blocks, self.free = h, be32(h, 0x28), be32(h, 0x2C), be32(h, 0x30)
        ensure(is_power(self.block) and 512 <= self.block <= 1 << 20, "bad allocation block size")
        ensure(self.free <= self.blocks, "more free blocks than blocks")
        self.size = self.block * self.blocks
        ensure(self.size >= 2560, "volume too small")
        ensure(self.size <= room, "file system larger than its partition")
        self.used = [(0, at), (at, at + 1536), (at + self.size - 1024, at + self.size)]

    def claim(self, first: int, n: int) -> None:
        at = self.start + first * self.block
        self.used.append((at, at + n * self.block))

    def fork(self, at: int) -> tuple[int, int, list[tuple[int, int]]]:
        """(bytes, blocks, extents) of a special file."""
        size, blocks, h = be64(self.header, at), be32(self.header, at + 12), self.header
        listed = [(be32(h, o), be32(h, o + 4)) for o in range(at + 16, at + 80, 8)]
        extents = [e for e in listed if e[1]]
        ensure(listed[: len(extents)] == extents and all(a + n <= self.blocks for a, n in extents), "bad special file extent")
        ensure(size <= blocks * self.block and sum(n for _, n in extents) <= blocks, "special file larger than its extents")
        for e in extents:
            self.claim(*e)
        return size, blocks, extents

    def read(self, extents: list[tuple[int, int]], at: int, n: int) -> bytes:
        out = b""
        for first, count in extents:
            length = count * self.block
            if at < length and len(out) < n:
                k = min(length - at, n - len(out))
                out += self.p.read(self.start + first * self.block + at, k)
                at += k
            at -= length
        ensure(len(out) == n, "B-tree node past the end of its file")
        return out


def _tree(v: _Volume, fork) -> tuple[int, int, int, int, int]:
    """(node size, nodes, depth, leaf records, first leaf)."""
    h = v.read(fork[2], 0, 512)
    ensure(h[8] == 1 and be16(h, 10) == 3, "bad B-tree header node")
    node, nodes, depth, records, first = be16(h, 32), be32(h, 36), be16(h, 14), be32(h, 20), be32(h, 24)
    ensure(is_power(node) and 512 <= node <= 32 << 10, "bad B-tree node size")
    ensure(0 < nodes * node <= fork[1] * v.block, "B-tree larger than its file")
    ensure(not (depth or first or records) or depth and 0 < first < nodes, "bad B-tree header")
    return node, nodes, depth, records, first


def _records(node: bytes) -> list[tuple[int, int]]:
    """(start, limit) of the records in a node."""
    n = be16(node, 10)
    limit = len(node) - 2 * (n + 1)
    starts = [be16(node, len(node) - 2 * (i + 1)) for i in range(n)]
    ensure(limit >= 14 and all(14 <= s < limit for s in starts), "bad B-tree record offset")
    return [(s, limit) for s in starts]


def _overflow(v: _Volume, fork) -> list[tuple[int, list[tuple[int, int]]]]:
    """Claims every extent in the overflow file; gives those of the bitmap file by first block."""
    size, nodes, _, expected, at = _tree(v, fork)
    out, seen, count = [], 0, 0
    while at:
        seen += 1
        ensure(at < nodes and seen <= nodes, "bad extents overflow leaf chain")
        node = v.read(fork[2], at * size, size)
        ensure(node[8:10] == b"\xff\x01", "bad extents overflow leaf")
        for start, limit in _records(node):
            ensure(start + 76 <= limit and be16(node, start) == 10, "bad extents overflow record")
            extents = []
            for o in range(start + 12, start + 76, 8):
                first, n = be32(node, o), be32(node, o + 4)
                if not n:
                    break
                ensure(first + n <= v.blocks, "extent outside the volume")
                v.claim(first, n)
                extents.append((first, n))
            if be32(node, start + 4) == BITMAP and node[start + 2] == 0:
                out.append((be32(node, start + 8), extents))
            count += 1
        at = be32(node, 0)
    ensure(count == expected, "extents overflow record count mismatch")
    return sorted(out)


def _journal(v: _Volume, block: int, mode: str) -> None:
    ensure(0 < block < v.blocks, "journal info block outside the volume")
    info = v.p.read(v.start + block * v.block, 52)
    v.claim(block, 1)
    flags, start, size = be32(info, 0), be64(info, 36), be64(info, 44)
    ensure(not flags & 2, "journal on another device")
    ensure(flags & 1 and size >= 512 and 1536 <= start and start + size <= v.size, "journal outside the volume")
    v.used.append((v.start + start, v.start + start + size))
    if mode != "copy" or flags & 4:
        return
    h = v.p.read(v.start + start, 48)
    word, wide = (be32, be64) if be32(h, 4) == ORDER else (le32, le64)
    ensure(word(h, 4) == ORDER and word(h, 0) in (JOURNAL, OLD_JOURNAL), "bad journal header")
    if word(h, 0) == JOURNAL:
        total = 0
        for b in h[:36] + bytes(4) + h[40:44]:
            total = (total << 8 & 0xFFFFFFFF) ^ (total + b & 0xFFFFFFFF)
        ensure(total ^ 0xFFFFFFFF == word(h, 36), "journal header checksum mismatch")
    ensure(wide(h, 8) == wide(h, 16), "journal needs replaying (not cleanly unmounted)")


def _name(v: _Volume, catalog) -> str | None:
    """The root folder's name: the first record of the catalog."""
    try:
        size, _, depth, _, first = _tree(v, catalog)
        node = v.read(catalog[2], first * size, size)
        start, limit = _records(node)[0]
    except (Bad, Short, IndexError):
        return None
    key, n = be16(node, start), be16(node, start + 6)
    data = start + 2 + key
    if not depth or node[8] != 0xFF or be32(node, start + 2) != 1 or n > 255 or key < 6 + 2 * n or data + 12 > limit or be16(node, data) != 1 or be32(node, data + 8) != 2:
        return None
    return node[start + 8 : start + 8 + 2 * n].decode("utf-16-be", "replace").strip(" \0\t\n") or None


def read(p: Source, mode: str, found: Found) -> Usage:
    h = p.upto(0, 1536)
    at, room = 0, p.size
    if not signed(h, 1024):
        ensure(embeds(h), "not HFS+")
        unit = be32(h, 1024 + 0x14)
        ensure(unit and unit % 512 == 0, "bad HFS wrapper allocation block size")
        at, room = be16(h, 1024 + 0x1C) * 512 + be16(h, 1024 + 0x7E) * unit, be16(h, 1024 + 0x80) * unit
        ensure(room and 1536 <= at and at + room <= p.size, "embedded HFS+ volume outside its wrapper")
    v = _Volume(p, at, room)
    flags = be32(v.header, 4)
    if mode == "copy":
        ensure(flags & UNMOUNTED, "not cleanly unmounted")
        ensure(not flags & INCONSISTENT, "marked inconsistent")
    if flags & JOURNALED:
        _journal(v, be32(v.header, 0x0C), mode)
    bitmap, extents, catalog, *_ = (v.fork(o) for o in (0x70, 0xC0, 0x110, 0x160, 0x1B0))
    ensure(sum(n for _, n in extents[2]) == extents[1], "extents overflow file extents missing")
    parts, more = list(bitmap[2]), _overflow(v, extents)
    if sum(n for _, n in parts) < bitmap[1]:
        ensure(len(parts) == 8, "allocation file extents missing")
        for first, listed in more:
            ensure(first == sum(n for _, n in parts), "allocation file extents don't line up")
            parts += listed
    else:
        ensure(not more, "stray allocation file extents")
    need = -(-v.blocks // 8)
    ensure(sum(n for _, n in parts) == bitmap[1], "allocation file extents missing")
    ensure(bitmap[0] >= need and bitmap[1] * v.block >= need, "allocation file too small")
    taken = 0
    for o in range(0, need, STEP):
        raw = bytearray(v.read(parts, o, min(STEP, need - o)))
        spare = 8 * (o + len(raw)) - v.blocks
        if spare > 0:  # bits beyond the volume say nothing
            raw[-1] &= 0xFF << spare & 0xFF
        taken += popcount(bytes(raw))
        for s, n in bit_runs(bytes(raw), 8 * len(raw), 8 * o, msb_first=True):
            v.claim(s, n)
    ensure(mode != "copy" or v.blocks - taken == v.free, "the allocation bitmap disagrees with the free block count")
    found.label = _name(v, catalog)
    return Usage(v.used, at + v.size, found.label)
