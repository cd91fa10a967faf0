"""The layout of a drive: its partitions, and the ranges that a copy needs. One failed check keeps a partition whole and says why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from strataspan.formats import bits, schemes, signatures
from strataspan.formats.filesystems import Found, Usage, apfs, btrfs, exfat, ext, f2fs, fat, hfsplus, lvm, ntfs, plain, udf, xfs
from strataspan.formats.reader import Bad, Short, Source

Reader = Callable[[Source, str, Found], Usage]
#: What can be read, by signature. Others register here.
READERS: dict[str, Reader] = {"vfat": fat.read, "exfat": exfat.read, "ntfs": ntfs.read, "ext": ext.read, "swap": plain.read_swap, "iso9660": plain.read_iso, "hfsplus": hfsplus.read, "LVM2_member": lvm.read, "xfs": xfs.read, "f2fs": f2fs.read, "udf": udf.read, "btrfs": btrfs.read, "apfs": apfs.read}
EDGE, HEAD_KEPT, ALIGN, GAP, MAX_EXTENTS = 1 << 20, 64 << 10, 4096, 65_536, 65_536


@dataclass
class Partition:
    index: int
    start: int
    size: int
    fs: str | None
    label: str | None
    used: int
    understood: bool
    why: str | None = None


@dataclass
class Layout:
    size: int
    table: str
    partitions: list[Partition]
    extents: list[tuple[int, int]]
    whole: str | None = None

    @property
    def used(self) -> int:
        return sum(e - s for s, e in self.extents)

    def json(self) -> dict:
        parts = [{k: v for k, v in asdict(p).items() if k != "why"} for p in self.partitions]
        return {"size": self.size, "table": self.table, "partitions": parts, "extents": [{"start": s, "len": e - s} for s, e in self.extents]}


def examine(p: Source, mode: str) -> tuple[str | None, str | None, Usage | None, str | None]:
    """(file system, label, usage, why it must be kept whole) of a partition."""
    try:
        head = p.upto(0, signatures.HEAD)
        found = signatures.detect(head)
        beyond = signatures.far(p)
        md = signatures.md_at_end(p)
    except Short as e:
        return None, None, None, f"unreadable: {e}"
    if beyond:
        return beyond, None, None, f"{beyond} signature past the start"
    strong = [f for f in found if f not in signatures.WEAK]
    if not found:
        return None, None, None, "nothing recognised"
    kind = (strong or found)[0]
    name = ext.name(head) if kind == "ext" else kind
    if len(strong) > 1:
        return name, None, None, "ambiguous, several signatures: " + ", ".join(strong)
    if kind not in READERS:
        return name, None, None, "not a file system that is read"
    if md is not None:
        return "linux_raid_member", None, None, "md RAID member"
    known = Found()
    try:
        usage = READERS[kind](p, mode, known)
    except Bad as e:
        return name, known.label, None, str(e)
    except Short as e:
        return name, known.label, None, f"metadata past the end: {e}"
    return name, usage.label or known.label, usage, None


def normalize(ranges: list[tuple[int, int]], size: int, gap: int = GAP, align: int = ALIGN, limit: int = MAX_EXTENTS) -> list[tuple[int, int]]:
    out = bits.merge([(s - s % align, min(-(-min(e, size) // align) * align, size)) for s, e in ranges], gap)
    while len(out) > limit:
        gap = 2 * max(gap, ALIGN)
        out = bits.merge(out, gap)
    return out


def overlap(extents: list[tuple[int, int]], start: int, size: int) -> int:
    return sum(max(0, min(e, start + size) - max(s, start)) for s, e in extents)


def analyze(s: Source, mode: str = "copy") -> Layout:
    """The layout of a drive or raw image. mode "estimate" believes file systems that aren't clean; never copy by that."""
    scheme = schemes.read(s)
    edge = min(EDGE, s.size)
    kept = [(0, edge), (s.size - edge, s.size), *scheme.fixed]
    parts = []
    for index, start, size in scheme.slots:
        name, label, usage, why = examine(s.window(start, size), mode)
        if usage is None:
            kept.append((start, start + size))
        else:
            clip = [(start + min(a, size), start + min(b, size)) for a, b in usage.used]
            kept += [*clip, (start, start + min(HEAD_KEPT, size)), (start + min(usage.end, size), start + size)]
        parts.append(Partition(index, start, size, name, label, 0, usage is not None and scheme.whole is None, why))
    if scheme.whole:
        kept.append((0, s.size))
    extents = normalize(kept, s.size)
    for p in parts:
        p.used = overlap(extents, p.start, p.size)
    return Layout(s.size, scheme.table, parts, extents, scheme.whole)
