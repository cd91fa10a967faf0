"""VHD, VHDX, VMDK, QCOW2 and DMG: each opens to an Image, or raises Bad with what is wrong or unsupported."""

from __future__ import annotations

import plistlib
import struct
import xml.parsers.expat
import zlib
from collections.abc import Iterator

from strataspan.formats import checksums
from strataspan.formats.pieces import Image, Piece, piece_bytes, stored, zeros
from strataspan.formats.reader import Bad, Patched, Short, Source, be16, be32, be64, ensure, field, is_power, le16, le32, le64, round_up

MIB = 1 << 20


# VHD


def _vhd_footer(b: bytes) -> dict | None:
    """A footer whose checksum holds; its last byte may be missing, as old versions wrote it."""
    if len(b) < 511 or b[:8] != b"conectix":
        return None
    b = b.ljust(512, b"\0")
    if checksums.ones_sum(b[:64] + b[68:]) != be32(b, 64):
        return None
    size, maker = be64(b, 48), b[28:32]
    cylinders, heads, sectors = be16(b, 56), b[58], b[59]
    if maker in (b"vpc ", b"qemu") and (cylinders, heads, sectors) != (65535, 16, 255):
        size = cylinders * heads * sectors * 512
    return {"kind": be32(b, 60), "size": size, "header": be64(b, 16)}


def vhd_footer(s: Source, head: bytes) -> dict | None:
    """At the start (dynamic disks keep a copy there) or in the last 512 or 511 bytes."""
    found = _vhd_footer(head[:512])
    if found and found["kind"] != 2:
        return found
    for n in (512, 511):
        if s.size >= n and (found := _vhd_footer(s.read(s.size - n, n))):
            return found
    return None


def open_vhd(s: Source, f: dict) -> Image:
    ensure(f["kind"] != 4, "a differencing VHD needs its parent")
    ensure(f["kind"] in (2, 3), "a VHD of an unknown type")
    if f["kind"] == 2:
        return Image("vhd", f["size"], s, iter([stored(f["size"], 0)]))
    h = s.upto(f["header"], 1024)
    ensure(h[:8] == b"cxsparse" and checksums.ones_sum(h[:36] + h[40:1024]) == be32(h, 36), "a damaged dynamic VHD header")
    table, count, block = be64(h, 16), be32(h, 28), be32(h, 32)
    ensure(is_power(block) and 512 <= block <= 256 * MIB, "a bad VHD block size")
    ensure(count * block >= f["size"], "a VHD block table too small")
    bitmap = round_up(-(-block // 512 // 8) or 1, 512)

    def pieces() -> Iterator[Piece]:
        for i in range(-(-f["size"] // block)):
            sector = be32(s.upto(table + 4 * i, 4), 0) if table + 4 * i + 4 <= s.size else 0xFFFFFFFF
            if sector == 0xFFFFFFFF:
                yield zeros(block)
                continue
            bits = s.read(sector * 512, bitmap)
            data = sector * 512 + bitmap
            full = -(-block // 512)
            if bits[: full // 8] == b"\xff" * (full // 8):
                yield stored(block, data)
                continue
            for k in range(full):  # a clear bit: the sector is zeros
                yield stored(512, data + 512 * k) if bits[k // 8] >> 7 - k % 8 & 1 else zeros(512)

    return Image("vhd", f["size"], s, pieces())


# VHDX

#: GUIDs of regions and metadata items, as they are stored.
_guid = lambda t: b"".join((bytes.fromhex(t[:8])[::-1], bytes.fromhex(t[9:13])[::-1], bytes.fromhex(t[14:18])[::-1], bytes.fromhex(t[19:23] + t[24:])))
BAT, METADATA = _guid("2DC27766-F623-4200-9D64-115E9BFD4A08"), _guid("8B7CA206-4790-4B9A-B8FE-575F050F886E")
FILE_PARAMETERS, DISK_SIZE, SECTOR = _guid("CAA16737-FA36-4D43-B3B6-33F0AA44E76B"), _guid("2FA54224-CD1B-4876-B211-5DBED83BF4B8"), _guid("8141BF1D-A96F-4709-BA47-F233A8FAAB5F")
LOG_MOST = 32 * MIB


def _with_zero(b: bytes, at: int) -> bytes:
    return b[:at] + bytes(4) + b[at + 4 :]


def open_vhdx(s: Source) -> Image:
    newest = None
    for at in (64 << 10, 128 << 10):
        h = s.upto(at, 4096)
        if h[:4] == b"head" and len(h) == 4096 and checksums.crc32c(_with_zero(h, 4)) == le32(h, 4) and (newest is None or le64(h, 8) > le64(newest, 8)):
            newest = h
    ensure(newest, "no valid VHDX header")
    ensure(le16(newest, 66) == 1, "an unknown VHDX version")
    if any(newest[48:64]):
        s = _replayed(s, newest)
    regions = next((found for at in (192 << 10, 256 << 10) if (found := _regions(s.upto(at, 64 << 10)))), None)
    ensure(regions and BAT in regions and METADATA in regions, "no valid VHDX region table")
    at, size = regions[METADATA]
    m = s.read(at, min(size, 64 << 10))
    ensure(m[:8] == b"metadata", "no VHDX metadata")
    items = {m[o : o + 16]: (le32(m, o + 16), le32(m, o + 20)) for o in range(32, 32 + 32 * le16(m, 10), 32)}
    ensure(all(k in items for k in (FILE_PARAMETERS, DISK_SIZE, SECTOR)), "VHDX metadata is missing")
    item = lambda k: s.read(at + items[k][0], items[k][1])
    block, flags = struct.unpack("<II", item(FILE_PARAMETERS)[:8])
    ensure(not flags & 2, "a differencing VHDX needs its parent")
    size, sector = le64(item(DISK_SIZE), 0), le32(item(SECTOR), 0)
    ensure(is_power(block) and MIB <= block <= 256 * MIB and sector in (512, 4096), "bad VHDX sizes")
    ratio = (1 << 23) * sector // block
    table, room = regions[BAT]

    def pieces() -> Iterator[Piece]:
        for i in range(-(-size // block)):
            index = i + i // ratio  # a sector bitmap entry follows each `ratio` blocks
            ensure(8 * index + 8 <= room, "a VHDX block table too small")
            e = le64(s.read(table + 8 * index, 8), 0)
            ensure(e & 7 != 7, "a VHDX block of a parent")
            yield stored(block, e >> 20 << 20) if e & 7 == 6 else zeros(block)

    return Image("vhdx", size, s, pieces())


def _regions(b: bytes) -> dict | None:
    if b[:4] != b"regi" or len(b) < 64 << 10 or checksums.crc32c(_with_zero(b, 4)) != le32(b, 4):
        return None
    known, out = (BAT, METADATA), {}
    for o in range(16, 16 + 32 * min(le32(b, 8), 2047), 32):
        kind = b[o : o + 16]
        ensure(kind in known or not le32(b, o + 28) & 1, "an unknown VHDX region")
        out[kind] = (le64(b, o + 16), le32(b, o + 24))
    return out


def _replayed(s: Source, header: bytes) -> Source:
    """The source with the log's newest complete sequence on top."""
    size, start, guid = le32(header, 68), le64(header, 72), header[48:64]
    ensure(0 < size <= LOG_MOST and size % 4096 == 0, "a bad VHDX log")
    log = s.read(start, size)
    ring = log + log
    entries = {}
    for at in range(0, size, 4096):
        n = le32(log, at + 8)
        if log[at : at + 4] == b"loge" and n % 4096 == 0 and 0 < n <= size and log[at + 32 : at + 48] == guid:
            e = ring[at : at + n]
            if checksums.crc32c(_with_zero(e, 4)) == le32(e, 4):
                entries[at] = e
    best: list[bytes] = []
    for at, e in entries.items():
        chain, here, number = [e], at, le64(e, 16)
        while (following := (here + le32(chain[-1], 8)) % size) in entries and le64(entries[following], 16) == number + 1 and len(chain) < len(entries):
            here, number = following, number + 1
            chain.append(entries[here])
        if le32(chain[-1], 12) == at and (not best or le64(chain[-1], 16) > le64(best[-1], 16)):
            best = chain
    ensure(best, "a VHDX log without a complete sequence")
    patches, end = [], s.size
    for e in best:
        count, number = le32(e, 24), le64(e, 16)
        data = round_up(64 + 32 * count, 4096)
        for k in range(count):
            d = e[64 + 32 * k : 96 + 32 * k]
            where = le64(d, 16)
            ensure(le64(d, 24) == number, "a torn VHDX log entry")
            if d[:4] == b"zero":
                patches.append((where, le64(d, 8), None))
            else:
                ensure(d[:4] == b"desc", "an unknown VHDX log entry")
                block = e[data : data + 4096]
                ensure(block[:4] == b"data" and le32(block, 4) << 32 | le32(block, 4092) == number, "a torn VHDX log sector")
                patches.append((where, 4096, d[8:16] + block[8:4092] + d[4:8]))
                data += 4096
        end = max(end, le64(e, 56))
    return Patched(s, patches, end)


# VMDK


def open_vmdk(s: Source) -> Image:
    h = s.upto(0, 512)
    if h[:4] != b"KDMV":
        raise Bad("a VMDK descriptor without data: its extents are in other files")
    if le64(h, 56) == (1 << 64) - 1:  # stream-optimised: the header that counts is at the end
        h = s.read(s.size - 1024, 512)
        ensure(h[:4] == b"KDMV", "no VMDK footer")
    flags, capacity, grain, per_table, directory = le32(h, 8), le64(h, 12), le64(h, 20), le32(h, 44), le64(h, 56)
    ensure(le32(h, 4) in (1, 2, 3), "an unknown VMDK version")
    ensure(is_power(grain) and 8 <= grain <= 128 << 11 and 0 < per_table <= 512, "bad VMDK sizes")
    packed = bool(flags & 1 << 16)
    ensure(not packed or le16(h, 77) == 1, "an unknown VMDK compression")
    text = s.upto(le64(h, 28) * 512, min(le64(h, 36) * 512, 1 << 20)).split(b"\0")[0].decode("latin-1") if le64(h, 28) else ""
    settings = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    value = lambda k: settings.get(k, "").strip().strip('"')
    ensure(value("parentCID").lower() in ("", "ffffffff"), "a VMDK snapshot needs its parent")
    ensure(value("createType") in ("", "monolithicSparse", "streamOptimized"), "a VMDK split over several files")
    size, step = capacity * 512, grain * 512

    def pieces() -> Iterator[Piece]:
        left = size
        for i in range(-(-size // (step * per_table))):
            table = le32(s.read(directory * 512 + 4 * i, 4), 0)
            if table == 0:
                yield zeros(step * per_table)
                left -= step * per_table
                continue
            raw = s.read(table * 512, 4 * per_table)
            for k in range(per_table):
                if left <= 0:
                    return
                n, where = min(step, left), le32(raw, 4 * k)
                left -= n
                if where == 0 or where == 1 and flags & 4:
                    yield zeros(n)
                elif packed:
                    yield Piece(n, "packed", where * 512 + 12, le32(s.read(where * 512 + 8, 4), 0), "zlib", step, True)
                else:
                    yield stored(n, where * 512)

    return Image("vmdk", size, s, pieces())


# QCOW2

PLACE = 0x00FFFFFFFFFFFE00


def open_qcow2(s: Source) -> Image:
    h = s.upto(0, 112)
    version, bits, size, roots, first = be32(h, 4), be32(h, 20), be64(h, 24), be32(h, 36), be64(h, 40)
    ensure(version in (2, 3), "an unknown QCOW version")
    ensure(9 <= bits <= 21, "a bad QCOW2 cluster size")
    ensure(be64(h, 8) == 0, "a QCOW2 with a backing file")
    ensure(be32(h, 32) == 0, "an encrypted QCOW2")
    features = be64(h, 72) if version == 3 else 0
    ensure(not features & ~0x1F, "unknown QCOW2 features")
    ensure(not features & 4, "a QCOW2 with its data in another file")
    codec = "zstd" if features & 8 and be32(h, 100) > 104 and h[104] == 1 else "deflate"
    wide = bool(features & 16)  # subclusters
    cluster, entry = 1 << bits, 16 if wide else 8
    per_table = cluster // entry
    ensure(roots * per_table * cluster >= size, "a QCOW2 table too small")
    shift = 70 - bits  # below: where a packed cluster is; above: how many further sectors it has

    def pieces() -> Iterator[Piece]:
        left = size
        for i in range(roots):
            if left <= 0:
                return
            table = be64(s.read(first + 8 * i, 8), 0) & PLACE
            if table == 0:
                yield zeros(cluster * per_table)
                left -= cluster * per_table
                continue
            raw = s.read(table, cluster)
            for k in range(per_table):
                if left <= 0:
                    return
                n, e = min(cluster, left), be64(raw, entry * k)
                left -= n
                if e & 1 << 62:
                    where, more = e & (1 << shift) - 1, e >> shift & (1 << bits - 8) - 1
                    yield Piece(n, "packed", where, (more + 1) * 512 - where % 512, codec, cluster, False)
                elif wide:
                    yield from _subclusters(be64(raw, entry * k + 8), e & PLACE, cluster, n)
                elif e & 1 and version == 3 or not e & PLACE:
                    yield zeros(n)
                else:
                    yield stored(n, e & PLACE)

    return Image("qcow2", size, s, pieces())


def _subclusters(bitmap: int, place: int, cluster: int, n: int) -> Iterator[Piece]:
    step = cluster // 32
    for k in range(32):
        if n <= 0:
            return
        m = min(step, n)
        n -= m
        held, zero = bitmap >> k & 1, bitmap >> 32 + k & 1
        ensure(not (held and zero), "a QCOW2 subcluster of two kinds")
        yield stored(m, place + k * step) if held and place else zeros(m)


# DMG

#: Kinds of chunks in a block map.
CHUNKS = {0: "zeros", 1: "raw", 2: "ignore", 0x80000004: "adc", 0x80000005: "zlib", 0x80000006: "bzip2", 0x80000007: "lzfse", 0x80000008: "xz"}
COMMENT, END = 0x7FFFFFFE, 0xFFFFFFFF


def dmg_trailer(s: Source) -> dict | None:
    if s.size < 512:
        return None
    k = s.read(s.size - 512, 512)
    if k[:4] != b"koly" or be32(k, 8) != 512:
        return None
    return {"data": be64(k, 24), "data_len": be64(k, 32), "rsrc": be64(k, 40), "rsrc_len": be64(k, 48), "parts": be32(k, 60), "xml": be64(k, 216), "xml_len": be64(k, 224), "sectors": be64(k, 492)}


def _blocks_of_fork(b: bytes) -> list[bytes]:
    """`blkx` resources of a resource fork."""
    data, at = be32(b, 0), be32(b, 4)
    kinds, out = at + be16(b, at + 24), []
    for i in range(be16(b, kinds) + 1):
        o = kinds + 2 + 8 * i
        if b[o : o + 4] == b"blkx":
            for k in range(be16(b, o + 4) + 1):
                r = kinds + be16(b, o + 6) + 12 * k
                where = data + (be32(b, r + 4) & 0xFFFFFF)
                out.append(b[where + 4 : where + 4 + be32(b, where)])
    return out


def open_dmg(s: Source, k: dict) -> Image:
    ensure(k["parts"] <= 1, "a DMG split over several files")
    blocks: list[bytes] = []
    if k["xml_len"]:
        try:
            tree = plistlib.loads(s.read(k["xml"], k["xml_len"]), fmt=plistlib.FMT_XML)
            blocks = [bytes(e["Data"]) for e in tree["resource-fork"]["blkx"]]
        except (KeyError, TypeError, ValueError, xml.parsers.expat.ExpatError) as e:
            raise Bad("a damaged DMG property list") from e
    elif k["rsrc_len"]:
        blocks = _blocks_of_fork(s.read(k["rsrc"], k["rsrc_len"]))
    ensure(blocks, "a DMG without block maps")
    found: list[tuple[int, int, str, int, int]] = []
    for b in blocks:
        ensure(b[:4] == b"mish", "a damaged DMG block map")
        first, data = be64(b, 8), be64(b, 24)
        ensure(len(b) >= 204 + 40 * be32(b, 200), "a DMG block map cut short")
        for i in range(be32(b, 200)):
            o = 204 + 40 * i
            kind = be32(b, o)
            if kind in (COMMENT, END):
                continue
            ensure(kind in CHUNKS, f"a DMG chunk of unknown kind {kind:#x}")
            count = be64(b, o + 16)
            if count:
                found.append((512 * (first + be64(b, o + 8)), 512 * count, CHUNKS[kind], k["data"] + data + be64(b, o + 24), be64(b, o + 32)))
    found.sort()
    ensure(all(a[0] + a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)), "DMG chunks that overlap")
    size = max(512 * k["sectors"], max((at + n for at, n, *_ in found), default=0))

    def pieces() -> Iterator[Piece]:
        at = 0
        for start, n, kind, where, packed in found:
            if start > at:
                yield zeros(start - at)
            if kind in ("zeros", "ignore"):
                yield zeros(n)
            elif kind == "raw":
                yield stored(min(n, packed), where)
                if packed < n:
                    yield zeros(n - packed)
            else:
                ensure(n <= 64 * MIB, "a DMG chunk too large")
                yield Piece(n, "packed", where, packed, kind, n, False)
            at = start + n

    return Image("dmg", size, s, pieces())


def dmg_sums(s: Source, k: dict, image: Image) -> list[tuple[int, int, bool]]:
    """(first byte, recorded CRC-32, whether it holds) of each block map with a CRC: over all its bytes, or over all but what
    it says to ignore."""
    out, placed = [], list(image.placed())
    tree = plistlib.loads(s.read(k["xml"], k["xml_len"]), fmt=plistlib.FMT_XML) if k["xml_len"] else None
    blocks = [bytes(e["Data"]) for e in tree["resource-fork"]["blkx"]] if tree else _blocks_of_fork(s.read(k["rsrc"], k["rsrc_len"]))
    for b in blocks:
        if be32(b, 64) != 2 or be32(b, 68) != 32:
            continue
        first, end = 512 * be64(b, 8), 512 * (be64(b, 8) + be64(b, 16))
        skip = [(first + 512 * be64(b, o + 8), first + 512 * (be64(b, o + 8) + be64(b, o + 16))) for o in range(204, 204 + 40 * be32(b, 200), 40) if be32(b, o) == 2]
        with_all = without = 0
        for at, p in placed:
            a, z = max(at, first), min(at + p.length, end)
            if a >= z:
                continue
            data = piece_bytes(s, p)[a - at : z - at]
            with_all = zlib.crc32(data, with_all)
            cut = a
            for x, y in [*[r for r in skip if r[0] < z and a < r[1]], (z, z)]:
                without = zlib.crc32(data[cut - a : max(cut, x) - a], without)
                cut = max(cut, y)
        out.append((first, be32(b, 72), be32(b, 72) in (with_all, without)))
    return out


__all__ = ["Short", "dmg_sums", "dmg_trailer", "field", "open_dmg", "open_qcow2", "open_vhd", "open_vhdx", "open_vmdk", "vhd_footer"]
