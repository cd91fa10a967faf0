"""UDF: what the space bitmap or table of its one partition doesn't list as free; without either, everything up to the last block recorded."""

from __future__ import annotations

from strataspan.formats import checksums
from strataspan.formats.bits import bit_runs
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Bad, Short, Source, be16, be32, ensure, le16, le32

#: Kinds of descriptors.
ANCHOR, POINTER, PARTITION, LOGICAL, END, INTEGRITY, SPACE_TABLE, SPACE_BITMAP = 2, 3, 5, 6, 8, 9, 263, 264
LONGEST, HOPS = 256, 16


def tagged(d: bytes, kind: int | None, at: int) -> bool:
    """Whether a descriptor of this kind (any, for None) belongs at this block; its CRC counts if it covers no more than the block."""
    if len(d) < 16 or kind is not None and le16(d, 0) != kind or le32(d, 12) != at:
        return False
    if (sum(d[:16]) - d[4]) & 0xFF != d[4] or le16(d, 2) not in (2, 3):
        return False
    n = le16(d, 10)
    return 16 + n > len(d) or checksums.crc_itu(d[16 : 16 + n]) == le16(d, 8)


def dstring(d: bytes) -> str | None:
    """Latin-1 or UTF-16BE by the first byte; the last one is the length."""
    n = min(d[-1], len(d) - 1)
    coding = {8: "latin-1", 16: "utf-16-be"}.get(d[0])
    if coding is None or n < 1:
        return None
    raw = d[1:n]
    return raw[: len(raw) // 2 * 2 if d[0] == 16 else None].decode(coding, "replace").rstrip("\0 ").strip() or None


class _Volume:
    def __init__(self, p: Source):
        self.p = p
        for self.block in (512, 1024, 2048, 4096):
            n = p.size // self.block
            for at in (256, n - 257, n - 1):
                if 256 <= at < n and tagged(d := self.at(at), ANCHOR, at):
                    self.anchor, self.blocks = d, n
                    return
        raise Bad("no UDF anchor")

    def at(self, block: int, n: int = 1) -> bytes:
        return self.p.read(block * self.block, n * self.block)

    def extent(self, d: bytes, o: int) -> tuple[int, int]:
        """(first block, blocks) of an extent given in bytes."""
        return le32(d, o + 4), le32(d, o) // self.block

    def sequence(self, first: int, n: int):
        """(partitions by number, logical volume) of a descriptor sequence: of several, those with the highest sequence number."""
        parts: dict[int, bytes] = {}
        logical, seen, hops = None, 0, 0
        while n:
            d = self.at(first)
            seen += 1
            ensure(seen <= LONGEST, "volume descriptor sequence too long")
            ensure(tagged(d, None, first), "bad volume descriptor")
            kind, first, n = le16(d, 0), first + 1, n - 1
            if kind == END:
                break
            if kind == POINTER:
                hops += 1
                ensure(hops <= HOPS, "too many volume descriptor pointers")
                first, n = self.extent(d, 20)
            elif kind == PARTITION:
                ensure(d[25:31] in (b"+NSR02", b"+NSR03"), "partition holds no UDF")
                old = parts.get(le16(d, 22))
                if old is None or le32(d, 16) > le32(old, 16):
                    parts[le16(d, 22)] = d
            elif kind == LOGICAL and (logical is None or le32(d, 16) > le32(logical, 16)):
                logical = d
        ensure(logical is not None, "no logical volume descriptor")
        ensure(parts, "no partition descriptor")
        return parts, logical

    def closed(self, first: int, n: int, access: int, mode: str) -> int | None:
        """The free count of the last integrity descriptor, which must say that the volume is closed."""
        last, seen, hops = None, 0, 0
        while n and (first + 1) * self.block <= self.p.size:
            d = self.at(first)
            seen += 1
            ensure(seen <= LONGEST, "integrity sequence too long")
            if not tagged(d, INTEGRITY, first):
                break
            last, first, n = d, first + 1, n - 1
            if le32(d, 32):
                hops += 1
                ensure(hops <= HOPS, "too many integrity extents")
                first, n = self.extent(d, 32)
        if last is None:
            ensure(access == 1, "no logical volume integrity descriptor")
            return None
        ensure(mode != "copy" or le32(last, 28) == 1, "volume still open (not cleanly unmounted)")
        free = le32(last, 80)
        return free if le32(last, 72) and free != 0xFFFFFFFF else None


def _by_bitmap(v: _Volume, start: int, blocks: int, size: int, at: int, free: int | None, mode: str) -> list[tuple[int, int]]:
    ensure(at < blocks, "space bitmap outside the partition")
    head = v.at(start + at)
    ensure(tagged(head, SPACE_BITMAP, at), "bad space bitmap")
    bits, n = le32(head, 16), le32(head, 20)
    ensure(bits == blocks and n == -(-bits // 8) and 24 + n <= size, "space bitmap size mismatch")
    own = (at, at + -(-(24 + n) // v.block))
    ensure(own[1] <= blocks, "space bitmap outside the partition")
    used, taken, step = [], 0, 4 << 20
    for o in range(0, n, step):
        raw = v.p.read((start + at) * v.block + 24 + o, min(step, n - o))
        for s, c in bit_runs(raw, min(8 * len(raw), bits - 8 * o), 8 * o, invert=True):
            used.append((s, s + c))
            taken += c
    if mode == "copy":
        ensure(sum(max(0, min(e, own[1]) - max(s, own[0])) for s, e in used) == own[1] - own[0], "space bitmap marks itself free")
        ensure(free is None or free == bits - taken, "free block count doesn't match the space bitmap")
    return used


def _by_table(v: _Volume, start: int, blocks: int, at: int, free: int | None, mode: str) -> list[tuple[int, int]]:
    ensure(at < blocks, "space table outside the partition")
    d = v.at(start + at)
    ensure(tagged(d, SPACE_TABLE, at), "bad space table")
    ensure(not le16(d, 34) & 7, "unsupported allocation descriptors")
    n = le32(d, 36)
    ensure(40 + n <= len(d), "space table longer than a block")
    ensure(n % 8 == 0, "bad space table length")
    listed = []
    for o in range(40, 40 + n, 8):
        ensure(le32(d, o) >> 30 != 3, "continued space table")
        count = -(-(le32(d, o) & 0x3FFFFFFF) // v.block)
        ensure(le32(d, o + 4) + count <= blocks, "free extent outside the partition")
        if count:
            listed.append((le32(d, o + 4), le32(d, o + 4) + count))
    used, here = [], 0
    for s, e in sorted(listed):
        ensure(s >= here, "overlapping free extents")
        ensure(not s <= at < e, "space table in free space")
        used.append((here, s))
        here = e
    ensure(mode != "copy" or free is None or free == sum(e - s for s, e in listed), "free block count doesn't match the space table")
    return [*used, (here, blocks)]


def _disc_end(p: Source) -> int:
    d = p.upto(0x8000, 2048)
    if len(d) < 2048 or d[0] != 1 or d[1:6] != b"CD001":
        return 0
    ensure(le32(d, 80) == be32(d, 84) and le16(d, 128) == be16(d, 130), "inconsistent ISO 9660 descriptor")
    return le32(d, 80) * le16(d, 128)


def read(p: Source, mode: str, found: Found) -> Usage:
    v = _Volume(p)
    main, reserve = v.extent(v.anchor, 16), v.extent(v.anchor, 24)
    whole = lambda o, d: (le32(d, o + 4), -(-le32(d, o) // v.block))
    kept = [(256, 1), whole(16, v.anchor), whole(24, v.anchor)]
    try:
        parts, logical = v.sequence(*main)
    except (Bad, Short):
        parts, logical = v.sequence(*reserve)
    found.label = dstring(logical[84:212])
    ensure(le32(logical, 212) == v.block, "logical block size differs from the sector size")
    ensure(le32(logical, 268) == 1 and 6 <= le32(logical, 264) <= len(logical) - 440, "not a single partition")
    ensure(logical[440:442] == b"\x01\x06", "virtual, sparable or metadata partition")
    d = parts.get(le16(logical, 444))
    ensure(d is not None, "partition missing")
    start, blocks = le32(d, 188), le32(d, 192)
    ensure(start + blocks <= v.blocks, "partition outside the volume")
    kept.append(whole(432, logical))
    for last in (v.blocks - 257, v.blocks - 1):
        if last > 256 and tagged(v.at(last), ANCHOR, last):
            kept.append((last, 1))
    free = v.closed(*v.extent(logical, 432), le32(d, 184), mode)
    used, end = [(0, start * v.block)], (start + blocks) * v.block
    inside = None
    if le32(d, 64) & 0x3FFFFFFF:
        inside = _by_bitmap(v, start, blocks, le32(d, 64) & 0x3FFFFFFF, le32(d, 68), free, mode)
    elif le32(d, 56) & 0x3FFFFFFF:
        inside = _by_table(v, start, blocks, le32(d, 60), free, mode)
    if inside is not None:
        used += [((start + s) * v.block, (start + e) * v.block) for s, e in inside]
    else:
        ensure(not any(le32(d, o) for o in (72, 80, 88)), "only freed space recorded (rewritable media)")
        last = max([start + blocks, *(a + n for a, n in kept)]) * v.block
        used.append((0, min(max(last, _disc_end(p)), p.size)))
        end = p.size
    used += [(a * v.block, min((a + n) * v.block, end)) for a, n in kept if a * v.block < end]
    return Usage(used, end, found.label)
