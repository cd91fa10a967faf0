"""XFS: in every allocation group, what the tree of free extents doesn't list is in use."""

from __future__ import annotations

from collections.abc import Iterator

from strataspan.formats import checksums
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Bad, Source, be16, be32, be64, ensure, le32

#: Version and feature bits.
SHARED, MOREBITS, DIRV2, EXTFLG, LOGV2 = 0x0200, 0x8000, 0x2000, 0x1000, 0x0400
FEATURES2, RO, INCOMPAT, META_UUID, LOG_INCOMPAT = 0x28A, 0xF, 0x1EF, 0x4, 0x1
LOG_MAGIC, NONE = 0xFEEDBABE, 0xFFFFFFFF
WINDOW = 8192  # log blocks looked at on either side of the head


def _sound(b: bytes, at: int) -> bool:
    """Whether the CRC-32C at this offset is that of the bytes with it cleared."""
    return at + 4 <= len(b) and checksums.crc32c(b[:at] + bytes(4) + b[at + 4 :]) == le32(b, at)


class _Volume:
    def __init__(self, p: Source):
        self.p = p
        sb = p.upto(0, 512)
        ensure(len(sb) == 512 and sb[:4] == b"XFSB", "not XFS")
        version = be16(sb, 100)
        ensure(version & 15 in (4, 5), "unsupported XFS version")
        self.v5, blog, slog = version & 15 == 5, sb[120], sb[121]
        ensure(9 <= blog <= 16 and 9 <= slog <= 15 and slog <= blog, "bad block size")
        self.block, self.sector = 1 << blog, 1 << slog
        ensure((be32(sb, 4), be16(sb, 102)) == (self.block, self.sector), "bad block size")
        if self.v5:
            ensure(_sound(p.upto(0, self.sector), 224), "superblock checksum mismatch")
            ensure(not be32(sb, 212) & ~RO, "unsupported read-only features")
            ensure(not be32(sb, 216) & ~INCOMPAT, "unsupported features (or needs repair)")
            ensure(not be32(sb, 220) & ~LOG_INCOMPAT, "unsupported log features")
        else:
            ensure(not version & SHARED, "shared XFS")
            ensure(version & DIRV2 and version & EXTFLG, "old XFS format")
            ensure(not version & MOREBITS or not be32(sb, 200) & ~FEATURES2, "unsupported features")
        ensure(sb[126] == 0, "mkfs didn't finish")
        ensure(not any(sb[16:32]), "realtime device")
        self.blocks, self.per_group, self.groups, shift = be64(sb, 8), be32(sb, 84), be32(sb, 88), sb[124]
        ensure(self.per_group >= 64 and 1 <= self.groups <= 1 << 20, "bad allocation groups")
        ensure(shift == (self.per_group - 1).bit_length(), "bad allocation group size")
        ensure(0 <= self.groups * self.per_group - self.blocks < self.per_group, "block count doesn't match the allocation groups")
        ensure(self.blocks * self.block <= p.size, "file system larger than its partition")
        start, self.log_uuid = be64(sb, 48), sb[32:48]
        ensure(start, "external log")
        group, inside, n = start >> shift, start & (1 << shift) - 1, be32(sb, 96)
        first = group * self.per_group + inside
        ensure(group < self.groups and inside < self.per_group and n >= 64 and first + n <= self.blocks, "log outside the file system")
        self.uuid = p.read(248, 16) if self.v5 and be32(sb, 216) & META_UUID else self.log_uuid
        self.log_at, self.log_blocks, self.log_v2 = first * self.block, n * self.block // 512, self.v5 or bool(version & LOGV2)
        self.label = sb[108:120].split(b"\0")[0].decode("utf-8", "replace").strip() or None

    def log(self, first: int, n: int) -> bytes:
        """Blocks of the ring, going on at its start."""
        first, n = first % self.log_blocks, min(n, self.log_blocks)
        head = min(n, self.log_blocks - first)
        return self.p.read(self.log_at + first * 512, head * 512) + (self.p.read(self.log_at, (n - head) * 512) if head < n else b"")

    def group(self, g: int, mode: str) -> list[tuple[int, int]]:
        start = g * self.per_group
        n, base, s = min(self.per_group, self.blocks - start), start * self.block, self.sector
        h = self.p.read(base, 4 * s)
        agf, agi, agfl = h[s : 2 * s], h[2 * s : 3 * s], h[3 * s :]
        for name, b in (("AGF", agf), ("AGI", agi)):
            ensure(b[:4] == b"X" + name.encode() and be32(b, 4) == 1 and be32(b, 8) == g, f"bad {name}")
            ensure(be32(b, 12) == n, "bad AG length")
        if self.v5:
            ensure(_sound(agf, 216) and agf[64:80] == self.uuid, "AGF checksum mismatch")
            ensure(_sound(agi, 312) and agi[296:312] == self.uuid, "AGI checksum mismatch")
            ensure(agfl[:4] == b"XAFL" and be32(agfl, 4) == g, "bad AGFL")
            ensure(_sound(agfl, 32) and agfl[8:24] == self.uuid, "AGFL checksum mismatch")
        used = [(base, base + min(max(4 * s, self.block), n * self.block))]
        free = list(self.leaves(g, n, b"AB3B" if self.v5 else b"ABTB", be32(agf, 16), be32(agf, 28)))
        at = 0
        for first, count in [*free, (n, 0)]:
            ensure(first >= at and first + count <= n and (count or first == n), "free space records out of order")
            used.append((base + at * self.block, base + first * self.block))
            at = first + count
        if mode == "copy":
            ensure(sum(c for _, c in free) == be32(agf, 52), "free block count doesn't match the free space tree")
            by_size = list(self.leaves(g, n, b"AB3C" if self.v5 else b"ABTC", be32(agf, 20), be32(agf, 32)))
            keys = [(c, f) for f, c in by_size]
            ensure(all(c and f + c <= n for f, c in by_size) and all(a < b for a, b in zip(keys, keys[1:], strict=False)), "free space records out of order")
            ensure((len(by_size), sum(c for _, c in by_size)) == (len(free), sum(c for _, c in free)), "free space trees disagree")
        return used

    def leaves(self, g: int, n: int, magic: bytes, at: int, levels: int) -> Iterator[tuple[int, int]]:
        """Records of a free-space tree from left to right."""
        ensure(1 <= levels <= 16, "bad free space tree height")
        head = 56 if self.v5 else 16
        for level in range(levels - 1, 0, -1):
            b = self.node(g, n, at, magic, level)
            most = (self.block - head) // 12
            ensure(be32(b, 8) == NONE, "free space tree's left edge has a left sibling")
            ensure(1 <= be16(b, 6) <= most, "bad free space tree node")
            at = be32(b, head + 8 * most)
        before = NONE
        for _ in range(n):
            b = self.node(g, n, at, magic, 0)
            ensure(be32(b, 8) == before, "free space tree siblings don't match")
            ensure(be16(b, 6) <= (self.block - head) // 8, "bad free space tree leaf")
            for o in range(head, head + 8 * be16(b, 6), 8):
                yield be32(b, o), be32(b, o + 4)
            before, at = at, be32(b, 12)
            if at == NONE:
                return
        raise Bad("free space tree leaves loop")

    def node(self, g: int, n: int, at: int, magic: bytes, level: int) -> bytes:
        ensure(0 < at < n, "free space tree block outside its AG")
        place = g * self.per_group + at
        b = self.p.read(place * self.block, self.block)
        ensure(b[:4] == magic and be16(b, 4) == level, "bad free space tree block")
        if self.v5:
            ensure(_sound(b, 52), "free space tree block checksum mismatch")
            ensure((be64(b, 16), b[32:48], be32(b, 48)) == (place * self.block // 512, self.uuid, g), "misplaced tree block")
        return b


def _cycle(b: bytes) -> int:
    return be32(b, 4) if be32(b, 0) == LOG_MAGIC else be32(b, 0)


def _clean(v: _Volume) -> None:
    """The log must end in a lone record of an unmount, its blocks before the head of one pass and those behind of the one before."""
    n, at = v.log_blocks, lambda k: _cycle(v.log(k, 1))
    first, last = at(0), at(n - 1)
    head, behind = 0, first
    if first != last:
        ensure(first == last + 1 & 0xFFFFFFFF, "log cycles don't follow each other")
        low, high = 0, n - 1
        while high - low > 1:
            middle = (low + high) // 2
            c = at(middle)
            ensure(c in (first, last), "log cycles out of order")
            low, high = (middle, high) if c == first else (low, middle)
        head, behind = high, last
    span = max(1, min(WINDOW, n // 2))
    back = min(span, head or n)
    start = (head or n) - back
    before, after = v.log(start, back), v.log(head, min(span, n - head))
    blocks = lambda raw: [raw[o : o + 512] for o in range(0, len(raw), 512)]
    ensure(all(_cycle(b) == first for b in blocks(before)), "torn writes before the log head")
    ensure(all(_cycle(b) == behind for b in blocks(after)), "log written past its head")
    k = next((i for i in range(back - 1, -1, -1) if be32(before, 512 * i) == LOG_MAGIC), None)
    ensure(k is not None, "no log record near the head (log not clean)")
    h, place = before[512 * k : 512 * k + 512], start + k
    version, length, size = be32(h, 8), be32(h, 12), be32(h, 320)
    ensure(be32(h, 4) == first and version in (1, 2) and length <= 256 << 10, "bad log record")
    ensure(h[304:320] == v.log_uuid, "log from another file system")
    heads = -(-size // (32 << 10)) if v.log_v2 and version & 2 and size > 32 << 10 else 1
    ensure(size <= 256 << 10 or heads == 1, "bad log record")
    data = (place + heads) % n
    ensure((data + -(-length // 512)) % n == head, "log not clean (records after the last unmount)")
    ensure(be32(h, 40) == 1, "log not clean (no unmount record)")
    record = v.log(data, max(1, -(-length // 512)))
    ensure(record[8] == 0xAA and record[9] & 0x20, "log not clean (no unmount record)")
    if v.v5 and le32(h, 32):
        more = v.log(place + 1, -(-length // (32 << 10)) - 1) if length > 32 << 10 else b""
        extra = b"".join(b[:260] for b in blocks(more))
        ensure(any(checksums.crc32c(h[:32] + bytes(4) + h[36:end] + extra + record[:length]) == le32(h, 32) for end in (328, 324)), "log record checksum mismatch")


def read(p: Source, mode: str, found: Found) -> Usage:
    found.label = p.upto(108, 12).split(b"\0")[0].decode("utf-8", "replace").strip() or None
    v = _Volume(p)
    if mode == "copy":
        _clean(v)
    used = [r for g in range(v.groups) for r in v.group(g, mode)]
    return Usage(used, v.blocks * v.block, v.label)
