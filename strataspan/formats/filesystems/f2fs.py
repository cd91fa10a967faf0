"""F2FS: the valid-block bitmaps of segments (highest bit first), entries in the checkpoint's journal in place of those in the table."""

from __future__ import annotations

from strataspan.formats import checksums
from strataspan.formats.bits import bit_runs, popcount
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Source, ensure, le16, le32, le64

MAGIC, BLOCK, SEGMENT = 0xF2F52010, 4096, 512
ENTRY, JOURNALLED = 74, 78
PER_BLOCK = BLOCK // ENTRY
#: Features and checkpoint flags.
ZONED, CHECKED, READ_ONLY, FEATURES = 0x2, 0x800, 0x4000, 0x3FFD
UNMOUNTED, COMPACT, FASTBOOT, CRC_RECOVERY, NOCRC_RECOVERY, LARGE_NAT, QUOTA = 0x1, 0x4, 0x20, 0x40, 0x200, 0x400, 0x800
BROKEN = 0x8 | 0x10 | 0x1000 | 0x2000 | 0x4000


def _sound(sb: bytes) -> bool:
    if le32(sb, 0) != MAGIC:
        return False
    return not le32(sb, 2180) & CHECKED or le32(sb, 32) == 3068 and checksums.crc32_raw(MAGIC, sb[:3068]) == le32(sb, 3068)


class _Volume:
    def __init__(self, p: Source):
        self.p = p
        sb, other = p.upto(1024, 3072), p.upto(BLOCK + 1024, 3072)
        ensure(len(sb) == 3072, "partition too small for F2FS")
        ensure(_sound(sb), "bad superblock")
        ensure(len(other) < 3072 or not _sound(other) or sb[:108] == other[:108], "superblocks disagree")
        features = le32(sb, 2180)
        ensure(not features & ZONED, "zoned F2FS")
        ensure(not features & READ_ONLY, "read-only F2FS image")
        ensure(not features & ~FEATURES, "unsupported features")
        ensure(sb[2201] == 0, "F2FS on several devices")
        ensure(9 <= le32(sb, 8) <= 12 and le32(sb, 12) == 12 - le32(sb, 8), "bad sector size")
        ensure((le32(sb, 16), le32(sb, 20)) == (12, 9), "unsupported block or segment size")
        blocks, total = le64(sb, 36), le32(sb, 48)
        ensure(blocks * BLOCK <= p.size, "file system larger than its partition")
        counts, places = [le32(sb, o) for o in range(52, 72, 4)], [le32(sb, o) for o in range(76, 96, 4)]
        ckpt, sit, nat, ssa, self.segments = counts
        ensure(ckpt == 2 and sit >= 2 and sit % 2 == 0 and nat >= 2 and ssa and self.segments, "bad layout")
        at = le32(sb, 72)
        for place, n in zip(places, counts, strict=True):
            ensure(place == at, "areas out of place")
            at += n * SEGMENT
        ensure(le32(sb, 72) >= 2 and sum(counts) <= total and le32(sb, 72) + total * SEGMENT <= blocks, "segments past the end")
        self.cp, self.sit, _, _, self.main = places
        self.sit_blocks = sit // 2 * SEGMENT
        ensure(-(-self.segments // PER_BLOCK) <= self.sit_blocks, "SIT too small")
        self.payload = le32(sb, 1664)
        self.label = sb[124:1148].decode("utf-16-le", "replace").split("\0")[0].strip() or None
        self._newest()

    def block(self, at: int, n: int = 1) -> bytes:
        return self.p.read(at * BLOCK, n * BLOCK)

    def _newest(self) -> None:
        """The checkpoint pack with the highest version whose first and last blocks are sound and agree."""
        ok = lambda b: le32(b, 164) in (4092, 192) and checksums.crc32_raw(MAGIC, b[: le32(b, 164)]) == le32(b, le32(b, 164))
        best = None
        for start in (self.cp, self.cp + SEGMENT):
            h = self.block(start)
            if not ok(h) or not 2 <= le32(h, 136) <= SEGMENT:
                continue
            last = self.block(start + le32(h, 136) - 1)
            if ok(last) and le64(last, 0) == le64(h, 0) and (best is None or le64(h, 0) > le64(best[1], 0)):
                best = (start, h)
        ensure(best, "no valid checkpoint")
        self.pack, self.header = best
        self.flags, self.length = le32(self.header, 132), le32(self.header, 136)
        ensure(le32(self.header, 140) < self.length, "bad checkpoint pack")

    def which(self) -> bytes:
        """A bit for each block of the table: which of its two copies is valid."""
        n = le32(self.header, 156)
        ensure(n == self.sit_blocks // 8, "bad SIT bitmap size")
        if not self.flags & LARGE_NAT and self.payload:
            ensure(-(-n // BLOCK) <= self.payload, "bad SIT bitmap size")
            return self.p.read((self.pack + 1) * BLOCK, n)
        at = 196 + le32(self.header, 160) if self.flags & LARGE_NAT else 192
        ensure(at + n <= BLOCK, "bad SIT bitmap")
        return self.header[at : at + n]

    def journal(self) -> dict[int, bytes]:
        """Newer entries by segment."""
        if self.flags & COMPACT:
            raw = self.block(self.pack + le32(self.header, 140))[507:]
        else:
            back = 7 if self.flags & (UNMOUNTED | FASTBOOT) else 4
            ensure(self.length > back, "bad checkpoint pack")
            raw = self.block(self.pack + self.length - back + 2)[512 * 7 :]
        n = le16(raw, 0)
        ensure(n <= 505 // JOURNALLED, "bad SIT journal")
        entries = [raw[2 + k * JOURNALLED : 2 + (k + 1) * JOURNALLED] for k in range(n)]
        return {le32(e, 0): e[4:] for e in reversed(entries)}  # the first entry of a segment counts

    def rolls_forward(self) -> bool:
        """Whether nodes written after the checkpoint wait to be recovered."""
        segment, offset = le32(self.header, 40), le16(self.header, 70)
        ensure(segment < self.segments and offset <= SEGMENT, "bad current segment")
        if offset == SEGMENT:
            return False
        found, version = le64(self.block(self.main + segment * SEGMENT + offset), 4084), le64(self.header, 0)
        if self.flags & NOCRC_RECOVERY:
            return found & 0xFFFFFFFF == version & 0xFFFFFFFF
        if self.flags & CRC_RECOVERY:
            version |= le32(self.header, le32(self.header, 164)) << 32
        return found == version


def read(p: Source, mode: str, found: Found) -> Usage:
    v = _Volume(p)
    found.label = v.label
    ensure(not v.flags & BROKEN, "checkpoint flags errors")
    if mode == "copy":
        ensure(v.flags & UNMOUNTED, "not cleanly unmounted")
        ensure(not v.flags & QUOTA, "quota needs fsck")
        ensure(not v.rolls_forward(), "fsync'd data to roll forward (not cleanly unmounted)")
    newer, which, used, valid = v.journal(), v.which(), [(0, v.main * BLOCK)], 0
    for k in range(-(-v.segments // PER_BLOCK)):
        raw = v.block(v.sit + k + (v.sit_blocks if which[k // 8] >> 7 - k % 8 & 1 else 0))
        for segment in range(k * PER_BLOCK, min((k + 1) * PER_BLOCK, v.segments)):
            o = (segment - k * PER_BLOCK) * ENTRY
            e = newer.get(segment, raw[o : o + ENTRY])
            n = le16(e, 0) & 0x3FF
            ensure(popcount(e[2:66]) == n, "SIT entry count mismatch")
            valid += n
            base = v.main + segment * SEGMENT
            used += [((base + s) * BLOCK, (base + s + c) * BLOCK) for s, c in bit_runs(e[2:66], SEGMENT, 0, msb_first=True)]
    ensure(mode != "copy" or valid == le64(v.header, 16), "valid block count doesn't match the SIT")
    return Usage(used, (v.main + v.segments * SEGMENT) * BLOCK, v.label)
