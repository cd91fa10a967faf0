"""ext2, ext3 and ext4: block bitmaps of groups, and the metadata that stands outside them."""

from __future__ import annotations

from strataspan.formats import checksums
from strataspan.formats.bits import bit_runs, popcount
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Source, byte_label, ensure, is_power, le16, le32, le64

#: Feature bits.
JOURNAL, SPARSE2 = 0x4, 0x200
RECOVER, JOURNAL_DEV, META_BG, WIDE, MMP, SEED = 0x4, 0x8, 0x10, 0x80, 0x100, 0x2000
INCOMPAT_KNOWN = 0x3F7D6  # all but compression, separate journal and lazy bitmaps
SPARSE, GDT_CSUM, BIGALLOC, METADATA_CSUM = 0x1, 0x10, 0x200, 0x400
RO_KNOWN = 0x1F77F  # all but snapshots and replicas
MAX_GROUPS, UNINIT = 1 << 20, 2


def name(head: bytes) -> str:
    sb = head[1024:]
    compat, incompat, ro = le32(sb, 0x5C), le32(sb, 0x60), le32(sb, 0x64)
    if incompat & JOURNAL_DEV:
        return "jbd"
    return "ext4" if ro & ~7 or incompat & ~0x16 else "ext3" if compat & JOURNAL else "ext2"


class _Volume:
    def __init__(self, sb: bytes, size: int, mode: str):
        compat, incompat, ro, rev = le32(sb, 0x5C), le32(sb, 0x60), le32(sb, 0x64), le32(sb, 0x4C)
        ensure(not incompat & JOURNAL_DEV, "external journal device")
        ensure(not incompat & ~INCOMPAT_KNOWN and not ro & ~RO_KNOWN, "unsupported features")
        ensure(rev <= 1 and (rev == 1 or not compat | incompat | ro), "unknown revision")
        self.uuid, self.crc = sb[0x68:0x78], None
        if ro & METADATA_CSUM:
            ensure(sb[0x175] == 1, "unknown checksum type")
            ensure(checksums.crc32c_raw(0xFFFFFFFF, sb[:0x3FC]) == le32(sb, 0x3FC), "superblock checksum mismatch")
            self.crc, self.seed = "c", le32(sb, 0x270) if incompat & SEED else checksums.crc32c_raw(0xFFFFFFFF, self.uuid)
        elif ro & GDT_CSUM:
            self.crc = "16"
        if mode == "copy":
            ensure(not incompat & RECOVER, "journal needs recovery (not cleanly unmounted)")
            ensure(le16(sb, 0x3A) & 3 == 1, "not cleanly unmounted, or has errors")
        log = le32(sb, 0x18)
        ensure(log <= 6, "bad block size")
        self.block, wide, big = 1024 << log, bool(incompat & WIDE), bool(ro & BIGALLOC)
        self.blocks, self.first = le32(sb, 4) | (le32(sb, 0x150) << 32 if wide else 0), le32(sb, 0x14)
        ensure(self.first == int(self.block == 1024 and not big), "bad first data block")
        self.per_group, self.shift, self.clusters = le32(sb, 0x20), 0, le32(sb, 0x20)
        if big:
            self.shift, self.clusters = le32(sb, 0x1C) - log, le32(sb, 0x24)
            ensure(0 <= self.shift <= 16, "bad cluster size")
            ensure(0 < self.clusters <= 8 * self.block and self.per_group == self.clusters << self.shift, "bad clusters per group")
        else:
            ensure(0 < self.per_group <= 8 * self.block, "bad blocks per group")
        ensure(self.blocks > self.first, "no blocks")
        ensure(self.blocks * self.block <= size, "file system larger than its partition")
        self.groups = -(-(self.blocks - self.first) // self.per_group)
        ensure(self.groups <= MAX_GROUPS, "too many groups")
        inodes, inode = le32(sb, 0x28), le16(sb, 0x58) if rev else 128
        ensure(0 < inodes <= 8 * self.block, "bad inodes per group")
        ensure(le32(sb, 0) == self.groups * inodes, "inode count doesn't match the groups")
        ensure(is_power(inode) and 128 <= inode <= self.block, "bad inode size")
        self.width = le16(sb, 0xFE) if wide else 32
        ensure(is_power(self.width) and 32 <= self.width <= 1024, "bad group descriptor size")
        ensure(not wide or self.width >= 64, "64bit with small group descriptors")
        self.per_block = self.block // self.width
        self.table = -(-self.groups // self.per_block)
        self.meta_bg = bool(incompat & META_BG)
        self.first_meta = le32(sb, 0x104) if self.meta_bg else self.table
        ensure(self.first_meta <= self.table, "bad first meta block group")
        self.inode_blocks, self.spare = -(-inodes * inode // self.block), le16(sb, 0xCE)
        self.sparse, self.two = bool(ro & SPARSE), [le32(sb, 0x24C), le32(sb, 0x250)] if compat & SPARSE2 else None
        self.mmp = le64(sb, 0x168) if incompat & MMP else None

    def start(self, g: int) -> int:
        return self.first + g * self.per_group

    def backup(self, g: int) -> bool:
        """Whether the group holds a copy of the superblock."""
        if g == 0 or self.two is not None:
            return g == 0 or g in self.two
        if g == 1 or not self.sparse:
            return True
        for base in (3, 5, 7):
            n = g
            while n % base == 0:
                n //= base
            if n == 1:
                return True
        return False

    def table_block(self, i: int) -> int:
        if i < self.first_meta:
            return int(self.block == 1024) + 1 + i
        g = i * self.per_block
        return self.start(g) + self.backup(g) + int(self.block == 1024 and i == 0 and self.first == 0)

    def descriptors(self, p: Source) -> bytes:
        ensure(self.groups * self.width <= 64 << 20, "group descriptor table too large")
        out, i = [], 0
        while i < self.table:
            at, n = self.table_block(i), 1
            while i + n < self.table and n * self.block < 4 << 20 and self.table_block(i + n) == at + n:
                n += 1
            ensure(at + n <= self.blocks, "descriptors outside the file system")
            out.append(p.read(at * self.block, n * self.block))
            i += n
        return b"".join(out)[: self.groups * self.width]

    def sound(self, g: int, d: bytes) -> bool:
        group = g.to_bytes(4, "little")
        if self.crc == "c":
            return checksums.crc32c_raw(self.seed, group + d[:0x1E] + b"\0\0" + d[0x20:]) & 0xFFFF == le16(d, 0x1E)
        if self.crc == "16":
            return checksums.crc16(0xFFFF, self.uuid + group + d[:0x1E] + d[0x20:]) == le16(d, 0x1E)
        return True

    def copies(self, g: int) -> list[tuple[int, int]]:
        """(block, count) of the superblock and descriptor copies in a group."""
        at, out = self.start(g), []
        if at == 0 and self.block == 1024:
            out.append((0, 1))
            at = 1
        has = self.backup(g)
        if has:
            out.append((at, 1))
        if g // self.per_block < self.first_meta:
            if has:
                out.append((at + 1, min(self.first_meta if self.meta_bg else self.table + self.spare, max(0, self.blocks - at - 1))))
        elif g % self.per_block in (0, 1, self.per_block - 1):
            out.append((at + has, 1))
        return out


def read(p: Source, mode: str, found: Found) -> Usage:
    sb = p.upto(1024, 1024)
    ensure(len(sb) == 1024, "partition too small for ext")
    ensure(le16(sb, 0x38) == 0xEF53, "not ext")
    found.label = byte_label(sb[0x78:0x88].split(b"\0")[0]) if not any(c > 127 for c in sb[0x78:0x88]) else sb[0x78:0x88].split(b"\0")[0].decode("utf-8", "replace").strip() or None
    v = _Volume(sb, p.size, mode)
    table, kept, maps = v.descriptors(p), [], []
    for g in range(v.groups):
        d = table[g * v.width : (g + 1) * v.width]
        ensure(v.sound(g, d), "group descriptor checksum mismatch")
        high = (lambda o, n=4: int.from_bytes(d[o : o + n], "little")) if v.width >= 64 else (lambda o, n=4: 0)
        places = [(le32(d, 0) | high(0x20) << 32, 1), (le32(d, 4) | high(0x24) << 32, 1), (le32(d, 8) | high(0x28) << 32, v.inode_blocks)]
        ensure(all(b >= v.first and b + n <= v.blocks for b, n in places), "group metadata outside the file system")
        kept += places + v.copies(g)
        if v.crc and le16(d, 0x12) & UNINIT:
            ensure(g, "group 0 marked uninitialized")
        else:
            maps.append((places[0][0], g, le16(d, 0x0C) | high(0x2C, 2) << 16, le16(d, 0x18) | high(0x38, 2) << 16))
    if v.mmp is not None and v.first <= v.mmp < v.blocks:
        kept.append((v.mmp, 1))
    used = [(b * v.block, (b + n) * v.block) for b, n in kept]
    for block, g, free, crc in sorted(maps):
        raw, first = p.read(block * v.block, v.block), v.start(g)
        bits = -(-min(v.blocks - first, v.per_group) // (1 << v.shift))
        if mode == "copy":
            if v.crc == "c":
                c = checksums.crc32c_raw(v.seed, raw[: v.clusters // 8])
                ensure((c if v.width >= 64 else c & 0xFFFF) == crc, "block bitmap checksum mismatch")
            whole, rest = divmod(bits, 8)
            taken = popcount(raw[:whole]) + (bin(raw[whole] & (1 << rest) - 1).count("1") if rest else 0)
            ensure(bits - taken <= free, "block bitmap frees more than its group descriptor says")
        unit, base = v.block << v.shift, first * v.block
        used += [(base + s * unit, base + (s + n) * unit) for s, n in bit_runs(raw, bits)]
    return Usage(used, v.blocks * v.block, found.label, name(p.upto(0, 2048)))
