"""Partition schemes: MBR with logical partitions and BSD labels, GPT, Apple maps, or none."""

from __future__ import annotations

from dataclasses import dataclass, field

from strataspan.formats import checksums, signatures
from strataspan.formats.reader import Bad, Short, Source, be16, be32, is_power, le16, le32, le64

EXTENDED = (0x05, 0x0F, 0x85)
BSD = {0xA5: "free", 0xA6: "open", 0xA9: "net"}
BSD_MAGIC = 0x82564557
MAX_LOGICAL, MAX_GPT, MAX_APM = 256, 4 << 20, 256


@dataclass
class Scheme:
    """table: none, mbr, gpt or apm. slots: (index, start, size). fixed: ranges kept in any case. whole: why all of the drive is."""

    table: str
    slots: list[tuple[int, int, int]] = field(default_factory=list)
    fixed: list[tuple[int, int]] = field(default_factory=list)
    whole: str | None = None


@dataclass(frozen=True)
class Entry:
    number: int
    boot: int
    kind: int
    start: int
    count: int

    def span(self, first: int, sector: int, size: int) -> tuple[int, int] | None:
        start = first * sector
        return (start, min((first + self.count) * sector, size)) if start < size else None


def entries(sector: bytes) -> list[Entry]:
    return [Entry(i + 1, *(sector[o : o + 1] or b"\0"), *(sector[o + 4 : o + 5] or b"\0"), le32(sector, o + 8), le32(sector, o + 12)) for i, o in enumerate(range(0x1BE, 0x1FE, 16))]


def read(s: Source) -> Scheme:
    head = s.upto(0, signatures.HEAD)
    scheme = _scan(s, head)
    scheme.whole = signatures.fake_raid(s) or scheme.whole
    md = signatures.md_at_end(s)
    if md is not None and not any(start <= md < start + size for _, start, size in scheme.slots):
        scheme.whole = "linux_raid_member"
    if scheme.table != "none":
        found, size = signatures.iso_size(head)
        if size is not None:
            scheme.fixed.append((0, min(size, s.size)))
        elif found:
            scheme.whole = "ISO 9660 image of unknown size"
    return scheme


def _bare(size: int) -> Scheme:
    return Scheme("none", [(0, 0, size)])


def _scan(s: Source, head: bytes) -> Scheme:
    if len(head) < 512:
        return _bare(s.size)
    apm, four = _apple(s, head), entries(head)
    signed = head[510:512] == b"\x55\xaa"
    if signed and any(e.kind == 0xEE for e in four):
        gpt = _gpt(s, four)
        if gpt:
            return _beside(gpt, apm)
    valid = signed and all(e.boot in (0, 0x80) for e in four)
    filled = valid and any(e.count and e.start * 512 < s.size for e in four)
    if filled:
        if signatures.boot_sector(head[:512]):
            scheme = _bare(s.size)
            scheme.whole = "both a boot sector and a partition table"
            return scheme
        return _beside(_mbr(s, four), apm)
    if apm:
        slots, fixed = [], list(apm[1])
        for index, start, end, kind in apm[0]:
            if kind == "data":
                slots.append((index, start, end - start))
            elif kind == "kept":
                fixed.append((start, end))
        return Scheme("apm", slots, fixed)
    if valid and not signatures.boot_sector(head[:512]) and not signatures.detect(head):
        return Scheme("mbr")
    return _bare(s.size)


def _beside(scheme: Scheme, apm) -> Scheme:
    """An Apple map next to another table: what it lists is kept."""
    if apm:
        scheme.fixed += apm[1] + [(start, end) for _, start, end, kind in apm[0] if kind != "free"]
    return scheme


def _votes(s: Source, four: list[Entry], sector: int) -> int:
    """How many entries point at something under this sector size."""
    n = 0
    for e in four:
        span = e.span(e.start, sector, s.size) if e.count else None
        if span is None:
            continue
        try:
            h = s.upto(span[0], min(span[1] - span[0], 512 if e.kind in EXTENDED else signatures.HEAD))
        except Short:
            continue
        n += h[510:512] == b"\x55\xaa" if e.kind in EXTENDED else bool(signatures.detect(h)) or e.kind in BSD and _bsd_order(h, sector) is not None
    return n


def _mbr(s: Source, four: list[Entry]) -> Scheme:
    small, large = _votes(s, four, 512), _votes(s, four, 4096)
    sector = 4096 if large > small else 512
    used = [e for e in four if e.count]
    scheme, labels, logical = Scheme("mbr"), [], []
    for e in used:
        span = e.span(e.start, sector, s.size)
        if span is None:
            continue
        if e.kind in EXTENDED:
            logical += _logical(s, e, sector, scheme)
            continue
        label = _bsd(s, e, sector)
        if label:
            labels.append(label)
        else:
            scheme.slots.append((e.number, span[0], span[1] - span[0]))
    number = 5
    for start, end in logical:
        scheme.slots.append((number, start, end - start))
        number += 1
    for boot, listed, kept in labels:
        scheme.fixed += [boot, *kept]
        for start, end in listed:
            if end > start:
                scheme.slots.append((number, start, end - start))
            number += 1
    scheme.slots.sort()
    if large <= small == 0 and all(e.start * 4096 < s.size for e in used):  # either reading may be right: keep both
        scheme.fixed += [x for e in used if (x := e.span(e.start, 4096, s.size))]
    return scheme


def _logical(s: Source, ext: Entry, sector: int, scheme: Scheme) -> list[tuple[int, int]]:
    """The chain of tables in an extended partition: each links to the next relative to the first."""
    out, seen = [], set()
    here, room, limit = ext.start, ext.count, ext.start + ext.count
    while here not in seen and len(seen) < MAX_LOGICAL:
        seen.add(here)
        pos = here * sector
        if pos + 512 > s.size:
            break
        try:
            b = s.read(pos, 512)
        except Short:
            scheme.fixed.append((pos, min(limit * sector, s.size)))
            break
        scheme.fixed.append((pos, pos + sector))
        if b[510:512] != b"\x55\xaa":
            break
        link = None
        for e in entries(b):
            if not e.count:
                continue
            if e.kind in EXTENDED:
                link = link or e
                continue
            first = here + e.start
            if e.number > 2 and not (e.start + e.count <= room and ext.start <= first and first + e.count <= limit):
                continue
            span = e.span(first, sector, s.size)
            if span:
                out.append(span)
        if link is None:
            break
        here, room = ext.start + link.start, link.count
    return out


def _gpt_header(s: Source, sector: int, lba: int) -> tuple[bytes, bytes] | None:
    """(header, entries) of a GPT copy whose checksums hold."""
    try:
        h = s.read(lba * sector, 512)
    except Short:
        return None
    n = le32(h, 12)
    if h[:8] != b"EFI PART" or not 92 <= n <= 512 or checksums.crc32(h[:16] + bytes(4) + h[20:n]) != le32(h, 16):
        return None
    first, last, count, width = le64(h, 40), le64(h, 48), le32(h, 80), le32(h, 84)
    if le64(h, 24) != lba or first > last or last >= s.size // sector or width < 128 or width % 128 or not is_power(width // 128) or count * width > MAX_GPT:
        return None
    try:
        e = s.read(le64(h, 72) * sector, count * width)
    except Short:
        return None
    return (h, e) if checksums.crc32(e) == le32(h, 88) else None


def _gpt(s: Source, four: list[Entry]) -> Scheme | None:
    places = [(x, 1) for x in (512, 4096)] + [(x, s.size // x - 1) for x in (512, 4096) if s.size >= x]
    found = next(((x, lba, g) for x, lba in places if (g := _gpt_header(s, x, lba))), None)
    if not found:
        return None
    sector, lba, (h, table) = found
    scheme = Scheme("gpt", [], [(lba * sector, (lba + 1) * sector), (le64(h, 72) * sector, le64(h, 72) * sector + len(table))])
    other = le64(h, 32)
    if other * sector < s.size:
        scheme.fixed.append((other * sector, (other + 1) * sector))
        copy = _gpt_header(s, sector, other)
        start = le64(copy[0], 72) * sector if copy else max(0, other * sector - len(table)) if lba == 1 else 2 * sector
        scheme.fixed.append((start, start + len(table)))
    width = le32(h, 84)
    for i in range(len(table) // width):
        e = table[i * width : (i + 1) * width]
        first, last = le64(e, 32), le64(e, 40)
        if e[:16] != bytes(16) and first <= last and first * sector < s.size:
            scheme.slots.append((i + 1, first * sector, min((last + 1) * sector, s.size) - first * sector))
    for e in four:  # a hybrid MBR may describe space that no entry covers
        span = e.span(e.start, sector, s.size) if e.count and e.kind != 0xEE and e.kind not in EXTENDED else None
        if span and not any(start <= span[0] and span[1] <= start + size for _, start, size in scheme.slots):
            scheme.fixed.append(span)
    return scheme


def _apple(s: Source, head: bytes):
    """([(index, start, end, free/kept/data)], fixed ranges) of an Apple partition map."""
    block = be16(head, 2)
    if head[:2] != b"ER" or block not in (512, 1024, 2048, 4096):
        return None
    first = s.upto(block, 512)
    count = be32(first, 4)
    if first[:2] != b"PM" or not 1 <= count <= MAX_APM:
        return None
    found, fixed = [], [(0, block)]
    for k in range(1, count + 1):
        b = s.upto(k * block, 512)
        if len(b) < 512 or b[:2] != b"PM":
            break
        fixed.append((k * block, (k + 1) * block))
        start, end = be32(b, 8) * block, min((be32(b, 8) + be32(b, 12)) * block, s.size)
        name = b[48:80].split(b"\0")[0].decode("latin-1").lower()
        kept = name in ("apple_partition_map", "apple_patches", "apple_fwdriver") or name.startswith("apple_driver")
        if start < end:
            found.append((k, start, end, "free" if name == "apple_free" else "kept" if kept else "data"))
    for k in range(min(be16(head, 16), 61)):
        start, size = be32(head, 18 + 8 * k) * block, max(be16(head, 22 + 8 * k) * 512, block)
        if start < s.size:
            fixed.append((start, min(start + size, s.size)))
    return found, fixed


def _bsd_order(h: bytes, sector: int):
    """The readers (16, 32 bits) of a label's byte order, by its two magics."""
    for w, d in ((le16, le32), (be16, be32)):
        if d(h, sector) == BSD_MAGIC == d(h, sector + 132):
            return w, d
    return None


def _bsd(s: Source, e: Entry, sector: int):
    """(boot range, listed ranges, kept ranges) of a BSD label that can be trusted in an MBR slice."""
    flavour = BSD.get(e.kind)
    start = e.start * sector
    if flavour is None or start >= s.size:
        return None
    length = min(e.count * sector, s.size - start)
    h = s.upto(start, min(length, signatures.HEAD))
    order = _bsd_order(h, sector)
    b = h[sector : sector + 512]
    if order is None or len(b) < 512:
        return None
    w, d = order
    n = w(b, 138)
    stop = 148 + 16 * n
    if not n or stop > 512 or checksums.xor16(b[:stop]) or d(b, 40) != sector:
        return None
    wide = flavour == "open" and w(b, 114) == 1
    if flavour == "open" and w(b, 114) > 1:
        return None
    base = e.start if flavour == "free" and d(b, 148 + 36) == 0 else 0
    first, last = e.start, e.start + e.count
    span = lambda p, q: (min(p * sector, s.size), min(q * sector, s.size))
    listed, kept = [], []
    for i in range(n):
        o = 148 + 16 * i
        size = d(b, o) | (w(b, o + 10) << 32 if wide else 0)
        p = base + (d(b, o + 4) | (w(b, o + 8) << 32 if wide else 0))
        q = p + size
        raw, inside = (p, size) == (first, e.count), first <= p and q <= last
        if i < (16 if flavour == "open" else 8) and b[o + 12] and not raw and inside:
            listed.append(span(p, q))
        elif not size or raw or q <= first or p >= last or p <= first and q >= last:
            continue
        elif inside:
            kept.append(span(p, q))
        else:
            return None
    if set(signatures.detect(h)) - {"ufs"} or _zfs_ring(s, start, length):
        return None
    boot = min(max(64 << 10, min(d(b, 140), 1 << 20)), length)
    return (start, start + boot), listed, kept


def _zfs_ring(s: Source, start: int, length: int) -> bool:
    if length < 256 << 10:
        return False
    try:
        ring = s.read(start + (128 << 10), 128 << 10)
    except Short:
        return True
    magic = (0x00BAB10C).to_bytes(8, "little")
    return any(ring[o : o + 8] in (magic, magic[::-1]) for o in range(0, len(ring), 1024))


__all__ = ["Bad", "Entry", "Scheme", "entries", "read"]
