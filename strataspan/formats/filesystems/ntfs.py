"""NTFS: the $Bitmap file; what of it is sparse or not initialised counts as in use."""

from __future__ import annotations

from strataspan.formats.bits import bit_runs
from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Bad, Short, Source, ensure, is_power, le16, le32, le64, utf16_label

LOG, VOLUME, BITMAP = 2, 3, 6
NAME, INFORMATION, DATA = 0x60, 0x70, 0x80
STEP = 4 << 20


def _repaired(raw: bytes, magics: tuple[bytes, ...]) -> bytes:
    """A record with the ends of its sectors put back; torn writes are Bad."""
    ensure(raw[:4] in magics, "bad record magic")
    at, n = le16(raw, 4), le16(raw, 6)
    ensure(n >= 2 and (n - 1) * 512 == len(raw) and at % 2 == 0 and at + 2 * n <= 512, "bad update sequence")
    out = bytearray(raw)
    for k in range(1, n):
        ensure(raw[k * 512 - 2 : k * 512] == raw[at : at + 2], "torn write in a metadata record")
        out[k * 512 - 2 : k * 512] = raw[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def _attribute(record: bytes, kind: int) -> bytes | None:
    at, stop = le16(record, 0x14), min(le32(record, 0x18), len(record))
    while True:
        ensure(at + 4 <= stop, "attributes run past the record")
        this = le32(record, at)
        if this == 0xFFFFFFFF:
            return None
        n = le32(record, at + 4)
        ensure(n >= 24 and n % 8 == 0 and at + n <= stop, "bad attribute")
        if this == kind and (kind != DATA or record[at + 9] == 0):
            return record[at : at + n]
        at += n


def _data(record: bytes) -> bytes:
    a = _attribute(record, DATA)
    ensure(a is not None, "$DATA not in the base record (attribute list)")
    return a


def _inside(a: bytes | None) -> bytes | None:
    """The value of a resident attribute."""
    if a is None or a[8]:
        return None
    n, at = le32(a, 0x10), le16(a, 0x14)
    return a[at : at + n] if at + n <= len(a) else None


class _Stream:
    """The data of a non-resident attribute."""

    def __init__(self, p: Source, a: bytes, cluster: int, clusters: int):
        ensure(a[8] == 1, "resident where non-resident was expected")
        ensure(not le16(a, 0x0C) & 0x40FF, "compressed or encrypted system file")
        ensure(le64(a, 0x10) == 0, "attribute split over several records")
        self.p, self.cluster, self.size, self.filled = p, cluster, le64(a, 0x30), le64(a, 0x38)
        self.runs: list[tuple[int, int, int | None]] = []  # first virtual cluster, count, place
        at, virtual, place = le16(a, 0x20), 0, 0
        while True:
            ensure(at < len(a), "truncated data runs")
            if a[at] == 0:
                break
            n, m = a[at] & 15, a[at] >> 4
            ensure(1 <= n <= 8 and m <= 8, "bad data run")
            ensure(at + 1 + n + m <= len(a), "truncated data runs")
            count = int.from_bytes(a[at + 1 : at + 1 + n], "little")
            ensure(0 < count <= clusters, "bad data run length")
            if m:
                place += int.from_bytes(a[at + 1 + n : at + 1 + n + m], "little", signed=True)
                ensure(place >= 0, "bad data run offset")
                ensure(place + count <= clusters, "data run outside the volume")
            self.runs.append((virtual, count, place if m else None))
            virtual += count
            at += 1 + n + m
        ensure(le64(a, 0x18) + 1 == virtual, "data runs don't match the attribute's size")

    def read(self, at: int, n: int, hole: bytes | None) -> bytes:
        out = bytearray()
        while len(out) < n:
            here = at + len(out)
            run = next((r for r in self.runs if r[0] <= here // self.cluster < r[0] + r[1]), None)
            ensure(run is not None, "read past the end of an attribute")
            into = here - run[0] * self.cluster
            m = min(run[1] * self.cluster - into, n - len(out))
            ensure(run[2] is not None or hole is not None, "sparse system file")
            out += self.p.read(run[2] * self.cluster + into, m) if run[2] is not None else hole * m
        return bytes(out)


def _clean(log: _Stream) -> bool:
    """An empty log, or one whose newer restart page says so."""
    empty, newest, at = True, None, 0
    while at < min(log.size, 64 << 10):
        b = log.read(at, 512, b"\0")
        if b[:4] == b"\xff" * 4:
            if not empty:
                break
        else:
            empty = False
            if b[:4] == b"RCRD":
                break
            area = _restart(log, at, b) if b[:4] in (b"RSTR", b"CHKD") else None
            if area:
                newest = max(newest, area) if newest else area
                if at:
                    break
        at = at * 2 or 512
    return empty or newest is not None and newest[1]


def _restart(log: _Stream, at: int, b: bytes) -> tuple[int, bool] | None:
    page, other = le32(b, 0x10), le32(b, 0x14)
    if not all(is_power(x) and 512 <= x <= 65536 for x in (page, other)) or at not in (0, page):
        return None
    try:
        raw = _repaired(log.read(at, page, b"\0"), (b"RSTR", b"CHKD"))
    except Bad:
        return None
    o = le16(raw, 0x18)
    if o % 8 or o + 0x30 > len(raw):
        return None
    return le64(raw, o), le16(raw, o + 0x0C) == 0xFFFF or bool(le16(raw, o + 0x0E) & 2)


def read(p: Source, mode: str, found: Found) -> Usage:
    b = p.upto(0, 512)
    ensure(len(b) == 512 and b[3:11] == b"NTFS    ", "not NTFS")
    sector, per = le16(b, 11), b[13] if b[13] <= 128 else 1 << (256 - b[13])
    ensure(is_power(sector) and 256 <= sector <= 4096, "bad bytes per sector")
    ensure(is_power(per), "bad sectors per cluster")
    cluster = sector * per
    ensure(cluster <= 2 << 20, "clusters too large")
    ensure(not any((le16(b, 14), b[16], le16(b, 17), le16(b, 19), le16(b, 22), le32(b, 32))), "FAT fields set in an NTFS boot sector")
    clusters, mft = le64(b, 40) // per, le64(b, 48)
    ensure(clusters > 0, "empty volume")
    ensure(le64(b, 40) * sector <= p.size, "file system larger than its partition")
    ensure(mft < clusters, "MFT outside the volume")
    code = int.from_bytes(b[64:65], "little", signed=True)
    record = code * cluster if code > 0 else 1 << -code if -31 <= code < 0 else 0
    ensure(is_power(record) and 512 <= record <= 65536, "bad MFT record size")
    table = _Stream(p, _data(_repaired(p.read(mft * cluster, record), (b"FILE",))), cluster, clusters)
    ensure(table.runs and table.runs[0][2] == mft, "MFT doesn't start where the boot sector says")

    def file(n: int) -> bytes:
        raw = _repaired(table.read(n * record, record, None), (b"FILE",))
        ensure(le16(raw, 0x16) & 1, "system file record not in use")
        return raw

    volume = file(VOLUME)
    name = _inside(_attribute(volume, NAME))
    found.label = utf16_label(name) if name else None
    if mode == "copy":
        info = _inside(_attribute(volume, INFORMATION))
        ensure(info is not None and len(info) >= 12 and not le16(info, 10) & 1, "volume marked dirty (needs chkdsk)")
        ensure(_clean(_Stream(p, _data(file(LOG)), cluster, clusters)), "$LogFile has changes to replay (not cleanly unmounted)")
    used = [(0, min(max(8192, cluster), p.size))]
    need, a = -(-clusters // 8), _data(file(BITMAP))
    mark = lambda raw, first: used.extend((s * cluster, (s + n) * cluster) for s, n in bit_runs(raw, min(clusters - first, 8 * len(raw)), first))
    if a[8] == 0:
        raw = _inside(a)
        ensure(raw is not None, "bad resident $Bitmap")
        ensure(len(raw) >= need, "$Bitmap too small")
        mark(raw, 0)
    else:
        bitmap = _Stream(p, a, cluster, clusters)
        ensure(bitmap.size >= need, "$Bitmap too small")
        for at in range(0, need, STEP):
            n = min(STEP, need - at)
            raw = bitmap.read(at, n, b"\xff")
            good = max(0, min(n, bitmap.filled - at))
            mark(raw[:good] + b"\xff" * (n - good), 8 * at)
    return Usage(used, clusters * cluster, found.label)


__all__ = ["Short", "read"]
