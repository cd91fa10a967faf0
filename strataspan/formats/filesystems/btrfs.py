"""btrfs on one device: metadata and system chunks whole, data chunks by the extents in them, on each stripe that holds them in one piece."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from strataspan.formats import checksums
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Source, ensure, is_power, le16, le32, le64

MIB, SUPER, SUPER_SIZE = 1 << 20, 64 << 10, 4096
#: Trees, item kinds, chunk types and profiles, features.
ROOTS, EXTENTS, CHUNKS, GROUPS, FIRST_CHUNK = 1, 2, 3, 11, 256
ROOT, EXTENT, METADATA_EXTENT, OLD_REF, GROUP, CHUNK = 132, 168, 169, 180, 192, 228
DATA, SYSTEM, METADATA = 1, 2, 4
RAID0, RAID1, DUP, RAID10, RAID5, RAID6, RAID1C3, RAID1C4 = (1 << k for k in range(3, 11))
KINDS, PROFILES = 7, 0x7F8
ERROR, FLAGS, INCOMPAT, OTHER_UUID, RO, GROUP_TREE = 1 << 2, 1 | 2 | 1 << 2 | 1 << 32, 0xFFF | 1 << 16, 1 << 10, 0xF, 1 << 3
HEADER, ITEM, POINTER = 101, 25, 33

Key = tuple[int, int, int]


def _key(b: bytes, at: int) -> Key:
    return le64(b, at), b[at + 8], le64(b, at + 9)


@dataclass(frozen=True)
class Chunk:
    logical: int
    size: int
    kind: int
    stripes: tuple[int, ...]
    piece: int  # bytes on each stripe

    @property
    def end(self) -> int:
        return self.logical + self.size

    @property
    def whole(self) -> bool:
        """Each stripe holds all of it, in order."""
        return self.piece == self.size

    @property
    def data(self) -> bool:
        return self.kind & KINDS == DATA


class _Volume:
    def __init__(self, p: Source):
        self.p = p
        sb = p.upto(SUPER, SUPER_SIZE)
        ensure(len(sb) == SUPER_SIZE, "partition too small")
        ensure(sb[0x40:0x48] == b"_BHRfS_M" and le64(sb, 0x30) == SUPER, "not btrfs")
        self.sums = le16(sb, 0xC4)
        ensure(self.sums in (0, 1), "unsupported checksum type")
        ensure(self.sound(sb), "superblock checksum mismatch")
        ensure(not le64(sb, 0x38) & ~FLAGS, "unfinished conversion, or a metadata dump")
        ensure(le64(sb, 0x88) == 1, "several devices")
        ensure(not le64(sb, 0xBC) & ~INCOMPAT, "unsupported features")
        ensure(not le64(sb, 0xB4) & ~RO, "unsupported read-only features")
        self.sector, self.node = le32(sb, 0x90), le32(sb, 0x94)
        ensure(is_power(self.sector) and 512 <= self.sector <= 65536, "bad sector size")
        ensure(is_power(self.node) and max(self.sector, 4096) <= self.node <= 65536, "bad node size")
        ensure(le32(sb, 0xA0) <= 2048, "bad system chunk array")
        self.device, self.size = le64(sb, 0xC9), le64(sb, 0xD1)
        ensure(self.size == le64(sb, 0x70) and MIB <= self.size <= p.size, "device size mismatch")
        self.fsid = sb[0x23B:0x24B] if le64(sb, 0xBC) & OTHER_UUID else sb[0x20:0x30]
        self.generation, self.super = le64(sb, 0x48), sb
        self.label = sb[0x12B:0x22B].split(b"\0")[0].decode("utf-8", "replace").strip() or None
        self.chunks: list[Chunk] = []
        self.starts: list[int] = []

    def sound(self, b: bytes) -> bool:
        return checksums.xxh64(b[32:]) == le64(b, 0) if self.sums else checksums.crc32c(b[32:]) == le32(b, 0)

    def mirrors(self, mode: str) -> None:
        for at in (64 * MIB, 256 << 30):
            if at + SUPER_SIZE <= self.size:
                m = self.p.read(at, SUPER_SIZE)
                ensure(m[0x40:0x48] == b"_BHRfS_M" and le64(m, 0x30) == at and self.sound(m) and m[0x20:0x30] == self.super[0x20:0x30], "bad superblock copy")
                ensure(mode != "copy" or le64(m, 0x48) == self.generation, "superblock copies of different generations")

    def chunk(self, logical: int, d: bytes) -> Chunk:
        n, sub = le16(d, 44), le16(d, 46)
        ensure(n and len(d) == 48 + 32 * n, "bad chunk item")
        size, kind = le64(d, 0), le64(d, 24)
        ensure(size and size % self.sector == 0 and logical % self.sector == 0, "bad chunk")
        ensure(kind & KINDS and not kind & ~(KINDS | PROFILES), "bad chunk type")
        copies = {0: n == 1, DUP: n == 2, RAID1: n >= 2, RAID1C3: n >= 3, RAID1C4: n >= 4}
        shares = {RAID0: n, RAID10: n // sub if sub >= 2 and n % sub == 0 else 0, RAID5: n - 1, RAID6: n - 2}
        profile = kind & PROFILES
        ensure(copies.get(profile) or shares.get(profile, 0) > 0, "bad chunk profile")
        piece = size if profile in copies else -(-size // shares[profile])
        stripes = []
        for o in range(48, len(d), 32):
            ensure(le64(d, o) == self.device, "chunk on another device")
            ensure(le64(d, o + 8) + piece <= self.size, "chunk past the end of the device")
            stripes.append(le64(d, o + 8))
        return Chunk(logical, size, kind, tuple(stripes), piece)

    def use(self, chunks: list[Chunk]) -> None:
        ensure(all(a.end <= b.logical for a, b in zip(chunks, chunks[1:], strict=False)), "overlapping chunks")
        self.chunks, self.starts = chunks, [c.logical for c in chunks]

    def around(self, logical: int) -> Chunk | None:
        k = bisect_right(self.starts, logical) - 1
        return self.chunks[k] if k >= 0 and logical < self.chunks[k].end else None

    def system_chunks(self) -> list[Chunk]:
        raw, at, out = self.super[0x32B : 0x32B + le32(self.super, 0xA0)], 0, []
        while at < len(raw):
            ensure(at + 65 <= len(raw), "bad system chunk array")
            n = 48 + 32 * le16(raw, at + 61)
            first, kind, logical = _key(raw, at)
            ensure(at + 17 + n <= len(raw) and (first, kind) == (FIRST_CHUNK, CHUNK), "bad system chunk array")
            out.append(self.chunk(logical, raw[at + 17 : at + 17 + n]))
            at += 17 + n
        return out

    def block(self, logical: int, level: int, generation: int, owner: int) -> bytes:
        ensure(logical % self.sector == 0, "misaligned tree block")
        c = self.around(logical)
        ensure(c and logical + self.node <= c.end, "tree block outside the chunks")
        ensure(c.whole and c.kind & (METADATA | SYSTEM), "tree block outside metadata")
        b = self.p.read(c.stripes[0] + logical - c.logical, self.node)
        ensure(self.sound(b), "tree block checksum mismatch")
        ensure(b[0x20:0x30] == self.fsid and le64(b, 0x30) == logical, "tree block of another file system, or misplaced")
        ensure(b[0x64] == level and le64(b, 0x58) == owner, "tree block level or owner mismatch")
        ensure(le64(b, 0x50) == generation <= self.generation, "tree block generation mismatch")
        return b

    def items(self, root: tuple[int, int, int], owner: int) -> Iterator[tuple[Key, bytes]]:
        """Items of a tree in order of their keys; root: (address, level, generation)."""
        ensure(root[1] <= 7, "bad tree level")
        stack: list[tuple[int, int, int, Key | None]] = [(*root, None)]
        last: Key | None = None
        budget = self.size // self.node + 1
        while stack:
            logical, level, generation, expected = stack.pop()
            budget -= 1
            ensure(budget >= 0, "tree too large")
            b = self.block(logical, level, generation, owner)
            n, width = le32(b, 0x60), POINTER if level else ITEM
            ensure(n <= (self.node - HEADER) // width and (n or not level and expected is None), "bad node")
            keys = [_key(b, HEADER + i * width) for i in range(n)]
            ensure(all(x < y for x, y in zip(keys, keys[1:], strict=False)) and (not keys or last is None or last < keys[0]), "keys out of order")
            ensure(expected is None or keys[0] == expected, "node doesn't start with its parent's key")
            if level:
                stack += [(le64(b, o + 17), level - 1, le64(b, o + 25), k) for k, o in reversed(list(zip(keys, range(HEADER, HEADER + n * width, width), strict=True)))]
                continue
            for k, o in zip(keys, range(HEADER, HEADER + n * width, width), strict=True):
                offset, size = le32(b, o + 17), le32(b, o + 21)
                ensure(offset >= n * ITEM and HEADER + offset + size <= self.node, "item outside its leaf")
                last = k
                yield k, b[HEADER + offset : HEADER + offset + size]


def _group(k: Key, d: bytes) -> tuple[int, int, int, int]:
    """(logical, size, kind, used) of a block group."""
    ensure(len(d) >= 24 and le64(d, 8) == FIRST_CHUNK, "bad block group item")
    ensure(le64(d, 0) <= k[2], "block group uses more than it has")
    return k[0], k[2], le64(d, 16), le64(d, 0)


def read(p: Source, mode: str, found: Found) -> Usage:
    v = _Volume(p)
    sb, found.label = v.super, v.label
    if mode == "copy":
        ensure(not le64(sb, 0x38) & ERROR, "file system has errors")
        ensure(le64(sb, 0x60) == 0, "log tree to replay (not cleanly unmounted)")
    v.mirrors(mode)
    system = v.system_chunks()
    v.use(system)
    chunks = []
    for k, d in v.items((le64(sb, 0x58), sb[0xC7], le64(sb, 0xA4)), CHUNKS):
        if k[1] == CHUNK:
            ensure(k[0] == FIRST_CHUNK, "bad chunk item")
            chunks.append(v.chunk(k[2], d))
    ensure(set(system) <= set(chunks), "system chunks differ from the chunk tree")
    v.use(chunks)
    places = sorted((s, s + c.piece) for c in chunks for s in c.stripes)
    ensure(all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False)), "overlapping chunks")
    roots = {}
    for k, d in v.items((le64(sb, 0x50), sb[0xC6], v.generation), ROOTS):
        if k[1] == ROOT and k[2] == 0 and k[0] in (EXTENTS, GROUPS):
            ensure(len(d) >= 239, "bad root item")
            roots[k[0]] = (le64(d, 176), d[238], le64(d, 160))
    ensure(EXTENTS in roots, "no extent tree")
    apart = bool(le64(sb, 0xB4) & GROUP_TREE)
    ensure((GROUPS in roots) == apart, "block group tree mismatch")
    inside: dict[int, list[tuple[int, int]]] = {}
    groups, at = [], 0
    for k, d in v.items(roots[EXTENTS], EXTENTS):
        ensure(k[1] != OLD_REF, "old extent format")
        if k[1] == GROUP and not apart:
            groups.append(_group(k, d))
        if k[1] not in (EXTENT, METADATA_EXTENT):
            continue
        c = v.around(k[0])
        ensure(c, "extent outside any chunk")
        if k[1] == METADATA_EXTENT:
            ensure(not c.data, "metadata in a data chunk")
            continue
        ensure(k[2] and k[0] + k[2] <= c.end, "extent crosses its chunk")
        if c.data:
            ensure(k[0] >= at, "overlapping extents")
            at = k[0] + k[2]
            inside.setdefault(c.logical, []).append((k[0] - c.logical, at - c.logical))
    if apart:
        groups += [_group(k, d) for k, d in v.items(roots[GROUPS], GROUPS) if k[1] == GROUP]
    ensure([g[:3] for g in groups] == [(c.logical, c.size, c.kind) for c in chunks], "block groups don't match the chunks")
    if mode == "copy":
        ensure(sum(g[3] for g in groups) == le64(sb, 0x78), "used bytes don't match the block groups")
        sums = {c: sum(e - s for s, e in r) for c, r in inside.items()}
        ensure(all(sums.get(c.logical, 0) == g[3] for c, g in zip(chunks, groups, strict=True) if c.data), "extents don't match their block group")
    used = [(0, min(MIB, v.size)), *((m, m + SUPER_SIZE) for m in (SUPER, 64 * MIB, 256 << 30) if m + SUPER_SIZE <= v.size)]
    for c in chunks:
        ranges = inside.get(c.logical, []) if c.data and c.whole else [(0, c.piece)]
        used += [(stripe + s, stripe + e) for stripe in c.stripes for s, e in ranges]
    return Usage(used, v.size, v.label)
