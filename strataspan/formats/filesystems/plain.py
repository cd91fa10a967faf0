"""Swap areas and ISO 9660 volumes."""

from __future__ import annotations

from strataspan.formats.filesystems import Found, Usage
from strataspan.formats.reader import Source, be16, be32, ensure, le16, le32, le64

SWAP = (b"SWAPSPACE2", b"SWAP-SPACE")
#: Signatures that hibernation writes in their place.
ASLEEP = (b"S1SUSPEND", b"S2SUSPEND", b"ULSUSPEND", b"LINHIB0001")
TUXONICE = bytes.fromhex("edc302e99856e50c")


def read_swap(p: Source, mode: str, found: Found) -> Usage:
    h = p.upto(0, 65536)
    page, magic = next(((n, m) for n in (4096, 8192, 16384, 32768, 65536) for m in SWAP + ASLEEP if h[n - 10 : n].startswith(m) and len(h) >= n), (0, b""))
    ensure(magic in SWAP and not h.startswith(TUXONICE), "holds a hibernation image")
    if magic == SWAP[0]:
        order = next((r for r in (le32, be32) if r(h, 1024) == 1), None)
        ensure(order, "unknown swap header version")
        last, bad = order(h, 1028), order(h, 1032)
        ensure(bad <= (page - 1546) // 4, "too many bad pages")
        ensure(last > 0 and (last + 1) * page <= p.size, "swap area larger than its partition")
        ensure(all(0 < order(h, 1536 + 4 * i) <= last for i in range(bad)), "bad page outside the swap area")
        found.label = h[1052:1068].split(b"\0")[0].decode("utf-8", "replace").strip() or None
    return Usage([(0, page)], p.size, found.label)


def read_iso(p: Source, mode: str, found: Found) -> Usage:
    d = p.upto(0x8000, 2048)
    ensure(len(d) == 2048, "partition too small for ISO 9660")
    ensure(d[0] == 1 and d[1:6] == b"CD001" and d[6] == 1, "no primary volume descriptor")
    ensure(le32(d, 80) == be32(d, 84) and le16(d, 128) == be16(d, 130), "inconsistent volume descriptor")
    block = le16(d, 128)
    ensure(block in (512, 1024, 2048), "bad logical block size")
    end = le32(d, 80) * block
    ensure(0x8800 <= end <= p.size, "volume larger than its partition, or too small")
    kinds = []
    for k in range(1, 64):
        if 0x8000 + (k + 1) * 2048 > end:
            break
        e = p.read(0x8000 + 2048 * k, 7)
        ensure(e[1:6] == b"CD001", "volume descriptor set not terminated")
        kinds.append(e[0])
        if e[0] == 255:
            break
    ensure(255 in kinds, "volume descriptor set not terminated")
    found.label = d[40:72].decode("utf-8", "replace").rstrip(" \0").strip() or None
    return Usage([(0, min(max(end, _hybrid(p.upto(0, 8192))), p.size))], p.size, found.label)


def _hybrid(h: bytes) -> int:
    """Where the partitions end that a table in the system area lists."""
    end = 0
    if h[510:512] == b"\x55\xaa":
        end = max((512 * (le32(h, o + 8) + le32(h, o + 12)) for o in range(0x1BE, 0x1FE, 16) if h[o + 4] and le32(h, o + 12)), default=0)
    for sector in (512, 2048, 4096):
        if h[sector : sector + 8] == b"EFI PART":
            end = max(end, (max(le64(h, sector + 32), le64(h, sector + 48)) + 1) * sector)
    return end
