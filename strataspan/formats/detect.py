"""What a file is, by a fixed order of tests: a disk image's body can look like a compressed stream, so containers come first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from strataspan.formats import codecs, sevenzip, smart, tar, vdisks
from strataspan.formats.pieces import Image, contents
from strataspan.formats.reader import Bad, Memory, Short, Source, le32, le64

#: The order of detection.
ORDER = ["vhdx", "qcow2", "vmdk", "vhd", "dmg", "7z", "tar", "bzip2", "lz4", "lzma", "gzip", "xz", "zstd", "zip", "raw"]
TRIAL = 64 << 10


@dataclass
class Info:
    format: str
    size: int
    uncompressed: int | None = None
    smart_size: int | None = None
    smart_used: int | None = None


def _lzma_header(h: bytes) -> bool:
    """A header of lzma alone that can be: its properties, a dictionary size that encoders write, a size that isn't absurd."""
    if len(h) < 14 or h[0] >= 225:
        return False
    d, n = le32(h, 1), le64(h, 5)
    usual = d == 0xFFFFFFFF or d >= 4096 and (d & d - 1 == 0 or (d // 3) * 3 == d and d // 3 & d // 3 - 1 == 0)
    return usual and d <= 1_610_612_736 | (d == 0xFFFFFFFF) and (n == (1 << 64) - 1 or 0 < n < 1 << 50) and h[13] == 0


def kind_of(s: Source) -> str:
    h = s.upto(0, 4096)
    if h[:8] == b"vhdxfile":
        return "vhdx"
    if h[:4] == b"QFI\xfb":
        return "qcow2"
    if h[:4] == b"KDMV" or h[:21] == b"# Disk DescriptorFile":
        return "vmdk"
    if vdisks._vhd_footer(h[:512]):
        return "vhd"
    if vdisks.dmg_trailer(s):
        return "dmg"
    if vdisks.vhd_footer(s, b""):
        return "vhd"
    if h[:6] == b"7z\xbc\xaf\x27\x1c":
        return "7z"
    if tar.is_header(h[:512]):
        return "tar"
    if h[:3] == b"BZh" and h[3:4] in b"123456789" and h[4:10] in (b"1AY&SY", b"\x17rE8P\x90"):
        return "bzip2"
    if le32(h, 0) in (codecs.LZ4, codecs.LZ4_LEGACY):
        return "lz4"
    if _lzma_header(h):
        try:
            piece = s.upto(0, TRIAL)
            if codecs.decode("xz", piece, TRIAL) or le64(h, 5) == 0:
                return "lzma"
        except Bad:
            pass
    for kind, magic in (("gzip", b"\x1f\x8b"), ("xz", b"\xfd7zXZ\0"), ("zstd", b"\x28\xb5\x2f\xfd"), ("zip", b"PK\x03\x04")):
        if h.startswith(magic):
            return kind
    return "zstd" if len(h) >= 4 and codecs.skippable(le32(h, 0)) else "raw"


def open_image(s: Source, kind: str | None = None) -> Image:
    """The virtual disk in a container format."""
    kind = kind or kind_of(s)
    if kind == "vhdx":
        return vdisks.open_vhdx(s)
    if kind == "qcow2":
        return vdisks.open_qcow2(s)
    if kind == "vmdk":
        return vdisks.open_vmdk(s)
    if kind == "vhd":
        return vdisks.open_vhd(s, vdisks.vhd_footer(s, s.upto(0, 512)))
    if kind == "dmg":
        return vdisks.open_dmg(s, vdisks.dmg_trailer(s))
    raise Bad(f"{kind} files aren't virtual disks")


CONTAINERS = frozenset({"vhdx", "qcow2", "vmdk", "vhd", "dmg"})


def probe(s: Source, magic: str = smart.MAGIC) -> Info:
    """Format and sizes, from headers alone. Damaged metadata leaves the size unknown."""
    kind = kind_of(s)
    info = Info(kind, s.size)
    try:
        if kind in CONTAINERS:
            info.uncompressed = open_image(s, kind).size
        elif kind == "tar":
            info.uncompressed = tar.first_file(s).size
        elif kind == "7z":
            info.uncompressed = sevenzip.first_file(s)[0]
        elif kind == "raw":
            info.uncompressed = s.size
        elif kind == "zstd":
            found = smart.read_map(s, magic)
            if found:
                info.uncompressed = info.smart_size = found[0]
                info.smart_used = sum(e - a for a, e in found[1])
            else:
                info.uncompressed = codecs.zstd_size(s)
        elif kind == "gzip":
            comment = smart.gzip_header(s, 0)[2]
            found = smart.parse(comment, smart.MAGIC_V1) if comment else None
            if found:
                info.uncompressed = info.smart_size = found[0]
                info.smart_used = sum(e - a for a, e in found[1])
        elif kind == "xz":
            info.uncompressed = codecs.xz_size(s)
        elif kind == "zip":
            info.uncompressed = codecs.zip_size(s)
        elif kind == "lzma":
            n = le64(s.read(5, 8), 0)
            info.uncompressed = None if n == (1 << 64) - 1 else n
    except (Bad, Short):
        pass
    return info


def raw_bytes(s: Source) -> Iterator[bytes]:
    """The bytes of the disk or file that an image holds. A tar within a compressed stream gives its first file."""
    kind = kind_of(s)
    if kind in CONTAINERS:
        yield from contents(open_image(s, kind))
    elif kind == "tar":
        yield from tar.contents(s, tar.first_file(s))
    elif kind == "7z":
        yield from sevenzip.first_file(s)[1]
    else:
        pieces = codecs.stream(kind, s)
        first = b""
        for piece in pieces:
            first += piece
            if len(first) >= 512:
                break
        if kind != "raw" and tar.is_header(first):
            whole = Memory(first + b"".join(pieces))
            yield from tar.contents(whole, tar.first_file(whole))
            return
        if first:
            yield first
        yield from pieces
