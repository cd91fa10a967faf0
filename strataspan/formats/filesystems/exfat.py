"""exFAT: the allocation bitmap united with everything that the directory tree claims."""

from __future__ import annotations

from strataspan.formats.bits import bit_runs
from strataspan.formats.checksums import rotate_add
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Bad, Source, ensure, le16, le32, le64, utf16_label

MAX_FOLDER, MAX_DEPTH, MAX_ENTRIES = 256 << 20, 256, 1 << 24
STEP = 4 << 20


class _Volume:
    def __init__(self, p: Source, fat: int, heap: int, cluster: int, clusters: int):
        self.p, self.fat, self.heap, self.cluster, self.clusters = p, fat, heap, cluster, clusters
        self.used: list[tuple[int, int]] = [(0, heap)]
        self.chained = self.entries = 0
        self.bitmaps: list[tuple[int, int]] = []
        self.upcase: tuple[int, int] | None = None
        self.folders: set[int] = set()
        self.todo: list[tuple[list[tuple[int, int]], int]] = []

    def span(self, first: int, count: int) -> tuple[int, int]:
        at = self.heap + (first - 2) * self.cluster
        return at, at + count * self.cluster

    def valid(self, c: int) -> bool:
        return 2 <= c < self.clusters + 2

    def chain(self, first: int, count: int | None, straight: bool) -> list[tuple[int, int]]:
        """Runs (first, count) of an allocation, straight or through the FAT; all of them are in use."""
        ensure(self.valid(first), "cluster out of range")
        if straight:
            n = count or 1
            ensure(first - 2 + n <= self.clusters, "allocation past the end of the volume")
            runs = [(first, n)]
        else:
            most = count if count is not None else max(1, min(MAX_FOLDER // self.cluster, self.clusters))
            ensure(1 <= most <= self.clusters, "allocation larger than the volume")
            runs, c, n = [(first, 1)], first, 1
            while True:
                self.chained += 1
                ensure(self.chained <= 2 * self.clusters + 1024, "cross-linked or looping cluster chains")
                if n == count:
                    break
                following = le32(self.p.read(self.fat + 4 * c, 4), 0)
                if following >= 0xFFFFFFF8:
                    ensure(count is None, "cluster chain too short")
                    break
                ensure(n < most, "directory too large, or a loop in its chain")
                ensure(self.valid(following), "broken cluster chain")
                start, length = runs[-1]
                if start + length == following:
                    runs[-1] = (start, length + 1)
                else:
                    runs.append((following, 1))
                c, n = following, n + 1
        self.used += [self.span(*r) for r in runs]
        return runs

    def system_file(self, first: int, size: int) -> tuple[int, int]:
        count = max(1, -(-size // self.cluster))
        run = self.chain(first, count, True)[0]
        try:
            chained = self.chain(first, count, False)
        except Bad:
            return run
        ensure(chained == [run], "fragmented system file")
        return run

    def claim(self, e: bytes, flags: int, folder: bool, depth: int) -> None:
        first, size = le32(e, 20), le64(e, 24)
        if not flags & 1 or not size:
            return
        runs = self.chain(first, -(-size // self.cluster), bool(flags & 2))
        if folder:
            ensure(size <= MAX_FOLDER and depth < MAX_DEPTH, "directory too large or too deep")
            ensure(first not in self.folders, "directory reachable twice")
            self.folders.add(first)
            self.todo.append((runs, depth + 1))

    def walk(self, runs: list[tuple[int, int]], root: bool, depth: int, found: Found) -> None:
        folder = False
        for first, count in runs:
            start, end = self.span(first, count)
            for at in range(start, end, 32 << 10):
                piece = self.p.read(at, min(32 << 10, end - at))
                for o in range(0, len(piece), 32):
                    e = piece[o : o + 32]
                    self.entries += 1
                    ensure(self.entries <= MAX_ENTRIES, "too many directory entries")
                    kind = e[0]
                    if kind == 0:
                        return
                    if not kind & 0x40:
                        folder = False
                    if kind < 0x80:
                        continue
                    if root and kind == 0x81:
                        self.bitmaps.append((le32(e, 20), le64(e, 24)))
                    elif root and kind == 0x82:
                        self.upcase = (le32(e, 20), le64(e, 24))
                    elif root and kind == 0x83:
                        found.label = utf16_label(e[2 : 2 + 2 * min(e[1], 11)])
                    elif kind == 0x85:
                        folder = bool(le16(e, 4) & 0x10)
                    elif kind == 0xC0:
                        is_folder, folder = folder, False
                        self.claim(e, e[1], is_folder, depth)
                    elif kind == 0xC1:
                        pass
                    elif 0xA0 <= kind <= 0xBF:
                        self.claim(e, e[2], False, depth)
                    elif kind >= 0xE0:
                        self.claim(e, e[1], False, depth)
                    else:
                        raise Bad(f"unknown critical directory entry {kind:#04x}")


def read(p: Source, mode: str, found: Found) -> Usage:
    b = p.upto(0, 512)
    ensure(len(b) == 512 and b[3:11] == b"EXFAT   " and not any(b[11:64]), "not exFAT")
    ensure(9 <= b[108] <= 12 and b[108] + b[109] <= 25, "bad sector or cluster size")
    sector, cluster = 1 << b[108], 1 << b[108] + b[109]
    fat, length, heap, clusters, root, copies = le32(b, 80), le32(b, 84), le32(b, 88), le32(b, 92), le32(b, 96), b[110]
    ensure(copies in (1, 2), "bad FAT count")
    ensure(fat >= 24 and heap >= fat + length * copies, "overlapping regions")
    ensure(1 <= clusters <= 0xFFFFFFF5, "bad cluster count")
    ensure(length * sector >= 4 * (clusters + 2), "FAT too small")
    ensure(le64(b, 72) * sector <= p.size, "file system larger than its partition")
    end = heap * sector + clusters * cluster
    ensure(end <= le64(b, 72) * sector, "cluster heap past the end of the volume")
    region = p.read(0, 12 * sector)
    total = rotate_add(region[: 11 * sector], (106, 107, 112)).to_bytes(4, "little")
    ensure(region[11 * sector :] == total * (sector // 4), "boot checksum mismatch")
    active = length if copies == 2 and le16(b, 106) & 1 else 0
    v = _Volume(p, (fat + active) * sector, heap * sector, cluster, clusters)
    ensure(v.valid(root), "bad root directory cluster")
    v.folders.add(root)
    v.walk(v.chain(root, None, False), True, 0, found)
    ensure(len(v.bitmaps) in (1, 2), "no allocation bitmap")
    need = -(-clusters // 8)
    for first, size in v.bitmaps:
        ensure(size >= need, "allocation bitmap too small")
        start = v.span(*v.system_file(first, size))[0]
        for at in range(0, need, STEP):
            piece = p.read(start + at, min(STEP, need - at))
            v.used += [v.span(2 + s, n) for s, n in bit_runs(piece, min(8 * len(piece), clusters - 8 * at), 8 * at)]
    if v.upcase:
        v.system_file(*v.upcase)
    while v.todo:
        runs, depth = v.todo.pop()
        v.walk(runs, False, depth, found)
    return Usage(v.used, end, found.label)
