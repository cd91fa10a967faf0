"""Small images made from rules, for queries and tests: no tools are needed."""

from __future__ import annotations

import plistlib
import struct
import zlib

from strataspan.formats import checksums

MASK = (1 << 64) - 1


class Noise:
    """A seeded xorshift generator."""

    def __init__(self, seed: int):
        self.x = (seed * 0x9E3779B97F4A7C15 | 1) & MASK

    def next(self) -> int:
        x = self.x
        x ^= x >> 12
        x = (x ^ x << 25) & MASK
        self.x = x ^ x >> 27
        return self.x * 0x2545F4914F6CDD1D & MASK

    def bytes(self, n: int) -> bytes:
        return b"".join(self.next().to_bytes(8, "little") for _ in range(-(-n // 8)))[:n]


def reference(size: int = 3 << 20) -> bytes:
    """Noise, zeros, text and a pattern, with an odd tail."""
    n = size // 6
    parts = [Noise(1).bytes(n), bytes(n), (b"all work and no play " * (n // 21 + 1))[:n], Noise(2).bytes(n), bytes(range(251)) * (n // 251), bytes(n // 2), Noise(3).bytes(1234)]
    return b"".join(parts)


def fat(bits: int, clusters: int, used: list[int], label: bytes = b"SAMPLE     ", sector: int = 512, per: int = 1, copies: int = 2) -> bytes:
    """A FAT volume whose `used` clusters are one-cluster chains."""
    entries = clusters + 2
    length = -(-entries * bits // 8 // sector) or 1
    reserved, roots = (32, 0) if bits == 32 else (1, 224 if bits == 12 else 512)
    root_sectors = roots * 32 // sector
    total = reserved + copies * length + root_sectors + clusters * per
    b = bytearray(sector)
    b[:3], b[3:11] = b"\xeb\x3c\x90", b"MKSAMPLE"
    struct.pack_into("<HBHBHHBH", b, 11, sector, per, reserved, copies, roots, total if total < 65536 and bits != 32 else 0, 0xF8, 0 if bits == 32 else length)
    struct.pack_into("<I", b, 32, 0 if total < 65536 and bits != 32 else total)
    if bits == 32:
        struct.pack_into("<I", b, 36, length)
        struct.pack_into("<I", b, 44, 2)
        b[0x42:0x52], b[0x47:0x52], b[0x52:0x5A] = b"\x29" + bytes(15), label, b"FAT32   "
    else:
        b[0x26:0x36], b[0x2B:0x36], b[0x36:0x3E] = b"\x29" + bytes(15), label, f"FAT{bits}   ".encode()
    b[510:512] = b"\x55\xaa"
    end = (1 << min(bits, 28)) - 1
    values = [0] * entries
    values[0], values[1] = end & ~7, end
    for c in used:
        values[c] = end
    if bits == 12:
        raw = bytearray(-(-entries * 3 // 2))
        for i, v in enumerate(values):
            o = i + i // 2
            two = int.from_bytes(raw[o : o + 2].ljust(2, b"\0"), "little")
            two = two | v << 4 if i % 2 else two | v
            raw[o : o + 2] = two.to_bytes(2, "little")[: len(raw) - o]
    else:
        raw = b"".join(v.to_bytes(bits // 8, "little") for v in values)
    table = bytes(raw[: length * sector]).ljust(length * sector, b"\0")
    data = Noise(9).bytes(clusters * per * sector)
    if bits == 32:  # the root directory is cluster 2: empty
        data = bytes(per * sector) + data[per * sector :]
    return bytes(b).ljust(reserved * sector, b"\0") + table * copies + bytes(root_sectors * sector) + data


def mbr(parts: list[tuple[int, int, int]], size: int, bodies: list[bytes]) -> bytes:
    """parts: (kind, first sector, sectors) of up to four primary partitions; bodies at their starts."""
    disk = bytearray(size)
    for i, (kind, first, count) in enumerate(parts):
        struct.pack_into("<BBBBBBBBII", disk, 0x1BE + 16 * i, 0, 0, 2, 0, kind, 0, 2, 0, first, count)
    disk[510:512] = b"\x55\xaa"
    for (_, first, _), body in zip(parts, bodies, strict=True):
        disk[first * 512 : first * 512 + len(body)] = body
    return bytes(disk)


def gpt(parts: list[tuple[int, int]], size: int, bodies: list[bytes]) -> bytes:
    """parts: (first sector, last sector); both copies of header and entries, and a protective MBR."""
    disk, last = bytearray(size), size // 512 - 1
    struct.pack_into("<BBBBBBBBII", disk, 0x1BE, 0, 0, 2, 0, 0xEE, 0xFF, 0xFF, 0xFF, 1, min(last, 0xFFFFFFFF))
    disk[510:512] = b"\x55\xaa"
    table = bytearray(128 * 128)
    for i, (a, b) in enumerate(parts):
        table[128 * i : 128 * i + 32] = Noise(77 + i).bytes(32)
        struct.pack_into("<QQ", table, 128 * i + 32, a, b)
    for lba, other, entries in ((1, last, 2), (last, 1, last - 32)):
        h = bytearray(512)
        struct.pack_into("<8sIIIIQQQQ16sQIII", h, 0, b"EFI PART", 0x10000, 92, 0, 0, lba, other, 34, last - 34, Noise(5).bytes(16), entries, 128, 128, zlib.crc32(table))
        struct.pack_into("<I", h, 16, zlib.crc32(h[:92]))
        disk[lba * 512 : lba * 512 + 512] = h
        disk[entries * 512 : entries * 512 + len(table)] = table
    for (a, _), body in zip(parts, bodies, strict=True):
        disk[a * 512 : a * 512 + len(body)] = body
    return bytes(disk)


def swap(pages: int = 64, label: bytes = b"swapper", magic: bytes = b"SWAPSPACE2") -> bytes:
    b = bytearray(pages * 4096)
    struct.pack_into("<III", b, 1024, 1, pages - 1, 0)
    b[1052 : 1052 + len(label)], b[4086:4096] = label, magic.ljust(10, b"\0")
    return bytes(b)


def iso(blocks: int = 200, label: bytes = b"SAMPLE_DISC") -> bytes:
    b = bytearray(blocks * 2048)
    p = 0x8000
    b[p : p + 7] = b"\x01CD001\x01"
    b[p + 40 : p + 72] = label.ljust(32)
    struct.pack_into("<I", b, p + 80, blocks)
    struct.pack_into(">I", b, p + 84, blocks)
    struct.pack_into("<H", b, p + 128, 2048)
    struct.pack_into(">H", b, p + 130, 2048)
    b[p + 2048 : p + 2055] = b"\xffCD001\x01"
    return bytes(b)


def ext2(groups: int = 1, used: int = 200, label: bytes = b"sample") -> bytes:
    """An ext2 volume of 1 KiB blocks with one group, its first `used` blocks taken."""
    blocks, inodes = 4096, 128
    b = bytearray(blocks * 1024)
    sb = bytearray(1024)
    struct.pack_into("<IIIIIIIIII", sb, 0, inodes, blocks, 0, blocks - 1 - used, inodes - 11, 1, 0, 0, 8192, 8192)
    struct.pack_into("<I", sb, 0x28, inodes)
    struct.pack_into("<HH", sb, 0x38, 0xEF53, 1)
    struct.pack_into("<I", sb, 0x4C, 1)
    struct.pack_into("<H", sb, 0x58, 128)
    sb[0x78 : 0x78 + len(label)] = label
    b[1024:2048] = sb
    struct.pack_into("<IIIHHH", b, 2048, 3, 4, 5, blocks - 1 - used, inodes - 11, 2)
    bits = bytearray(1024)
    for i in range(used):
        bits[i // 8] |= 1 << i % 8
    for i in range(blocks - 1, 8192):
        bits[i // 8] |= 1 << i % 8
    b[3072:4096] = bits
    return bytes(b)


def exfat(clusters: int = 600, used: int = 40, label: str = "SAMPLE") -> bytes:
    """exFAT of 4 KiB clusters: bitmap in cluster 2, root in cluster 3, then `used` more clusters taken."""
    sector, cluster, fat_at, heap = 512, 4096, 24, 64
    length = -(-(clusters + 2) * 4 // sector)
    volume = heap + clusters * 8
    b = bytearray(volume * sector)
    boot = bytearray(512)
    boot[:3], boot[3:11] = b"\xeb\x76\x90", b"EXFAT   "
    struct.pack_into("<QQIIIIIIIHHBBBBB", boot, 64, 0, volume, fat_at, length, heap, clusters, 3, 0x1234, 0, 0x100, 0, 9, 3, 1, 0x80, 0)
    struct.pack_into("<I", boot, 100, 0x1234)
    boot[104:106], boot[106:108] = b"\0\1", b"\0\0"
    boot[108], boot[109], boot[110] = 9, 3, 1
    boot[510:512] = b"\x55\xaa"
    region = bytes(boot) + b"".join(bytes(510) + b"\x55\xaa" for _ in range(8)) + bytes(1024)
    total = checksums.rotate_add(region, (106, 107, 112)).to_bytes(4, "little")
    b[: 12 * 512] = region + total * 128
    for c in (0, 1, 2, 3):
        struct.pack_into("<I", b, fat_at * 512 + 4 * c, 0xFFFFFFFF)
    at = lambda c: heap * 512 + (c - 2) * cluster
    for i in range(2 + used):
        b[at(2) + i // 8] |= 1 << i % 8
    root = bytearray()
    root += struct.pack("<BB18xIQ", 0x81, 0, 2, -(-clusters // 8))
    name = label.encode("utf-16-le")
    root += (bytes([0x83, len(label)]) + name).ljust(32, b"\0")
    b[at(3) : at(3) + len(root)] = root
    return bytes(b)


def _vhd_footer(size: int, kind: int, header: int) -> bytes:
    f = bytearray(512)
    struct.pack_into(">8sIIQI4sI4sQQHBBI", f, 0, b"conectix", 2, 0x10000, header, 0, b"smpl", 0x10000, b"Wi2k", size, size, 65535, 16, 255, kind)
    struct.pack_into(">I", f, 64, checksums.ones_sum(bytes(f)))
    return bytes(f)


def vhd_fixed(disk: bytes) -> bytes:
    disk = disk.ljust(-(-len(disk) // 512) * 512, b"\0")
    return disk + _vhd_footer(len(disk), 2, MASK)


def vhd_dynamic(disk: bytes, block: int = 1 << 16) -> bytes:
    disk = disk.ljust(-(-len(disk) // 512) * 512, b"\0")
    count, foot = -(-len(disk) // block), _vhd_footer(len(disk), 3, 512)
    head = bytearray(1024)
    struct.pack_into(">8sQQIII", head, 0, b"cxsparse", MASK, 1536, 0x10000, count, block)
    struct.pack_into(">I", head, 36, checksums.ones_sum(bytes(head)))
    table_len = -(-4 * count // 512) * 512
    table, body, at = bytearray(b"\xff" * table_len), b"", 1536 + table_len
    for i in range(count):
        data = disk[i * block : (i + 1) * block].ljust(block, b"\0")
        if any(data):
            bits = bytearray(512)
            for k in range(block // 512):
                if any(data[512 * k : 512 * k + 512]):
                    bits[k // 8] |= 0x80 >> k % 8
            struct.pack_into(">I", table, 4 * i, (at + len(body)) // 512)
            body += bytes(bits[: max(512, -(-block // 512 // 8 // 512) * 512)]) + data
    return foot + bytes(head) + bytes(table) + body + foot


def qcow2(disk: bytes, bits: int = 16, packed: bool = False, version: int = 3) -> bytes:
    cluster = 1 << bits
    n = -(-len(disk) // cluster)
    per = cluster // 8
    roots = -(-n // per)
    head = bytearray(cluster)
    struct.pack_into(">4sIQIIQIIQQIIQ", head, 0, b"QFI\xfb", version, 0, 0, bits, len(disk), 0, roots, cluster, 0, 0, 0, 0)
    if version == 3:
        struct.pack_into(">QQQII", head, 72, 0, 0, 0, 4, 104)
    l1_len = -(-8 * roots // cluster) * cluster
    l1, tables, data = bytearray(l1_len), [bytearray(cluster) for _ in range(roots)], b""
    base = cluster + l1_len + roots * cluster
    for i in range(n):
        piece = disk[i * cluster : (i + 1) * cluster].ljust(cluster, b"\0")
        if not any(piece):
            continue
        if packed:
            c = zlib.compressobj(6, zlib.DEFLATED, -12)
            raw = c.compress(piece) + c.flush()
            where = base + len(data)
            sectors = (where % 512 + len(raw) + 511) // 512 - 1
            entry = 1 << 62 | sectors << 70 - bits | where
            data += raw
        else:
            data = data.ljust(-(-len(data) // cluster) * cluster, b"\0")
            entry = 1 << 63 | base + len(data)
            data += piece
        struct.pack_into(">Q", tables[i // per], 8 * (i % per), entry)
    for k in range(roots):
        struct.pack_into(">Q", l1, 8 * k, 1 << 63 | cluster + l1_len + k * cluster)
    return bytes(head) + bytes(l1) + b"".join(map(bytes, tables)) + data + bytes(1024)


def vmdk_sparse(disk: bytes, packed: bool = False) -> bytes:
    grain, per = 128, 512
    step = grain * 512
    capacity = -(-len(disk) // 512)
    n = -(-capacity // grain)
    directory = -(-n // per)
    text = b"# Disk DescriptorFile\nversion=1\nCID=12345678\nparentCID=ffffffff\ncreateType=\"%s\"\n" % (b"streamOptimized" if packed else b"monolithicSparse")
    tables_at = 1 + 20 + 1
    head = bytearray(512)
    struct.pack_into("<4sIIQQQQIQQQB4sH", head, 0, b"KDMV", 3 if packed else 1, 0x30001 if packed else 1, capacity, grain, 1, 20, per, 0, 21, 0, 0, b"\n \r\n", 1 if packed else 0)
    gd, tables, body = bytearray(512), bytearray(directory * 2048), b""
    at = tables_at + directory * 4
    at += -at % 128
    base = at * 512
    for i in range(n):
        piece = disk[i * step : (i + 1) * step].ljust(step, b"\0")
        if any(piece):
            where = (base + len(body)) // 512
            if packed:
                raw = zlib.compress(piece)
                body += (struct.pack("<QI", i * grain, len(raw)) + raw).ljust(-(-(12 + len(raw)) // 512) * 512, b"\0")
            else:
                body += piece
            struct.pack_into("<I", tables, 4 * i, where)
    for k in range(directory):
        struct.pack_into("<I", gd, 4 * k, tables_at + 4 * k)
    out = bytes(head) + text.ljust(20 * 512, b"\0") + bytes(gd) + bytes(tables)
    return out.ljust(base, b"\0") + body


def dmg(disk: bytes, codec: str = "zlib", chunk: int = 1 << 18) -> bytes:
    disk = disk.ljust(-(-len(disk) // 512) * 512, b"\0")
    kinds = {"zlib": (0x80000005, zlib.compress), "bzip2": (0x80000006, __import__("bz2").compress), "raw": (1, bytes)}
    kind, pack = kinds[codec]
    body, rows = b"", b""
    for at in range(0, len(disk), chunk):
        piece = disk[at : at + chunk]
        row = (at // 512, len(piece) // 512)
        if not any(piece):
            rows += struct.pack(">IIQQQQ", 2, 0, *row, len(body), 0)
            continue
        raw = pack(piece)
        rows += struct.pack(">IIQQQQ", kind, 0, *row, len(body), len(raw))
        body += raw
    rows += struct.pack(">IIQQQQ", 0xFFFFFFFF, 0, len(disk) // 512, 0, len(body), 0)
    mish = bytearray(struct.pack(">4sIQQQII24xII128xI", b"mish", 1, 0, len(disk) // 512, 0, 512, 0, 2, 32, len(rows) // 40)) + rows
    struct.pack_into(">I", mish, 72, zlib.crc32(disk))
    xml = plistlib.dumps({"resource-fork": {"blkx": [{"ID": "0", "Name": "disk", "Data": bytes(mish)}]}})
    koly = bytearray(512)
    struct.pack_into(">4sIII", koly, 0, b"koly", 4, 512, 1)
    struct.pack_into(">QQQQII", koly, 24, 0, len(body), 0, 0, 1, 1)
    struct.pack_into(">QQ", koly, 216, len(body), len(xml))
    struct.pack_into(">Q", koly, 492, len(disk) // 512)
    return body + xml + bytes(koly)


def lvm(volumes: dict[str, bytes], extent: int = 1 << 16, extents: int = 400, gap: int = 3) -> bytes:
    """A physical volume with plain logical volumes, each in two pieces with a gap between."""
    start = 1 << 20
    crc = lambda b: checksums.crc32_raw(0xF597A6CF, b)
    uuid = "abcdefghijklmnopqrstuvwxyz012345"
    disk = bytearray(start + extents * extent)
    text, at = [], 2
    for name, body in volumes.items():
        n = max(2, -(-len(body) // extent))
        half = n // 2
        parts = [(0, half, at), (half, n - half, at + half + gap)]
        body = body.ljust(n * extent, b"\0")
        segments = "".join(f'segment{k + 1} {{ start_extent = {o} extent_count = {c} type = "striped" stripe_count = 1 stripes = [ "pv0", {e} ] }}\n' for k, (o, c, e) in enumerate(parts))
        text.append(f'{name} {{ id = "x" status = ["READ", "WRITE", "VISIBLE"] # comment }}\n flags = [] segment_count = 2\n {segments} }}\n')
        for o, c, e in parts:
            disk[start + e * extent : start + (e + c) * extent] = body[o * extent : (o + c) * extent]
        at += n + 2 * gap
    dashed = "-".join([uuid[:6], *(uuid[i : i + 4] for i in range(6, 26, 4)), uuid[26:]])
    meta = f'vg1 {{\nid = "y"\nseqno = 7\nformat = "lvm2"\nextent_size = {extent // 512}\nphysical_volumes {{ pv0 {{ id = "{dashed}" pe_start = {start // 512} pe_count = {extents} }} }}\nlogical_volumes {{ {"".join(text)} }}\n}}\ncontents = "Text Format Volume Group"\n'.encode() + b"\0"
    area, size = 4096, start - 4096
    h = bytearray(512)
    struct.pack_into("<16sIQQQQII", h, 4, b" LVM2 x[5A%r0N*>", 1, area, size, 512, len(meta), crc(meta), 0)
    struct.pack_into("<I", h, 0, crc(bytes(h[4:])))
    disk[area : area + 512], disk[area + 512 : area + 512 + len(meta)] = h, meta
    label = bytearray(512)
    struct.pack_into("<8sQII8s", label, 0, b"LABELONE", 1, 0, 32, b"LVM2 001")
    struct.pack_into("<32sQQQQQQQQQII", label, 32, uuid.encode(), len(disk), start, 0, 0, 0, area, size, 0, 0, 2, 1)
    struct.pack_into("<I", label, 16, crc(bytes(label[20:])))
    disk[512:1024] = label
    return bytes(disk)


def hfsplus(blocks: int = 512, used: int = 60, name: str = "Sample") -> bytes:
    """HFS+ of 4 KiB blocks: bitmap in block 1, an empty overflow tree in 2, a catalog with the root folder in 3 to 4; `used` blocks taken."""
    block = 4096
    disk = bytearray(blocks * block)
    h = bytearray(512)
    struct.pack_into(">2sHI", h, 0, b"H+", 4, 1 << 8)
    struct.pack_into(">III", h, 0x28, block, blocks, blocks - used - 1)
    fork = lambda at, size, first, n: struct.pack_into(">QIIII", h, at, size, 0, n, first, n)
    fork(0x70, -(-blocks // 8), 1, 1)
    fork(0xC0, block, 2, 1)
    fork(0x110, 2 * block, 3, 2)
    disk[1024:1536] = disk[-1024:-512] = h
    for i in [*range(used), blocks - 1]:
        disk[block + i // 8] |= 0x80 >> i % 8

    def header(at: int, node: int, nodes: int, depth: int, records: int, first: int) -> None:
        disk[at + 8] = 1
        struct.pack_into(">H", disk, at + 10, 3)
        struct.pack_into(">HIIIIHHII", disk, at + 14, depth, first, records, first, first, node, 37, nodes, 0)

    header(2 * block, 4096, 1, 0, 0, 0)
    header(3 * block, 4096, 2, 1, 1, 1)
    leaf, raw = 4 * block, name.encode("utf-16-be")
    disk[leaf + 8], disk[leaf + 9] = 0xFF, 1
    struct.pack_into(">H", disk, leaf + 10, 1)
    record = struct.pack(">HIH", 6 + len(raw), 1, len(name)) + raw + struct.pack(">HHII", 1, 0, 0, 2) + bytes(78)
    disk[leaf + 14 : leaf + 14 + len(record)] = record
    struct.pack_into(">HH", disk, leaf + 4092, 14 + len(record), 14)
    return bytes(disk)


def smart_v1(disk: bytes, extents: list[tuple[int, int]]) -> bytes:
    """A version 1 smart image: gzip members with their sizes, the map in the first one's comment."""
    from strataspan.formats import smart

    def member(data: bytes, comment: bytes = b"") -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(data) + c.flush()
        n = 24 + len(comment) + 8 + len(raw)
        head = b"\x1f\x8b\x08" + bytes([4 | 16 * bool(comment)]) + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"DG", 8, n, len(data))
        return head + comment + raw + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)

    out = member(b"", smart.to_text(len(disk), extents, smart.MAGIC_V1).encode() + b"\0")
    return out + b"".join(member(bytes(n) if free else disk[at : at + n]) for at, n, free in smart.plan(len(disk), extents))


def ntfs(clusters: int = 2000, used: int = 30, label: str = "SAMPLE", dirty: bool = False) -> bytes:
    """NTFS of 4 KiB clusters: MFT in cluster 4, $Bitmap in cluster 10 (non-resident), an empty $LogFile in 12; `used` clusters taken."""
    cluster, record = 4096, 1024
    disk = bytearray(clusters * cluster)
    disk[:11], disk[510:512] = b"\xeb\x52\x90NTFS    ", b"\x55\xaa"
    struct.pack_into("<HB", disk, 11, 512, 8)
    struct.pack_into("<QQQb", disk, 40, clusters * 8, 4, 5, -10)

    def attribute(kind: int, body: bytes | None = None, runs: bytes = b"", count: int = 0, size: int = 0) -> bytes:
        if body is not None:
            n = -(-(24 + len(body)) // 8) * 8
            return struct.pack("<IIBBHHHIHH", kind, n, 0, 0, 24, 0, 0, len(body), 24, 0).ljust(24, b"\0") + body.ljust(n - 24, b"\0")
        n = -(-(64 + len(runs)) // 8) * 8
        return struct.pack("<IIBBHHHQQHHIQQQ", kind, n, 1, 0, 64, 0, 0, 0, count - 1, 64, 0, 0, count * cluster, size, size) + runs.ljust(n - 64, b"\0")

    def put(number: int, attributes: list[bytes]) -> None:
        body = b"".join(attributes) + b"\xff\xff\xff\xff\0\0\0\0"
        b = bytearray(record)
        struct.pack_into("<4sHHQHHHHII", b, 0, b"FILE", 48, 3, 0, 1, 1, 56, 1, 56 + len(body), record)
        b[56 : 56 + len(body)] = body
        b[48:50] = b"\x07\0"
        for k in (1, 2):
            b[48 + 2 * k : 50 + 2 * k] = b[512 * k - 2 : 512 * k]
            b[512 * k - 2 : 512 * k] = b"\x07\0"
        at = 4 * cluster + number * record
        disk[at : at + record] = b

    put(0, [attribute(0x80, runs=b"\x11\x04\x04\0", count=4, size=4 * cluster)])
    put(2, [attribute(0x80, runs=b"\x11\x02\x0c\0", count=2, size=2 * cluster)])
    put(3, [attribute(0x60, label.encode("utf-16-le")), attribute(0x70, bytes(8) + b"\x03\x01" + bytes([dirty, 0]))])
    put(6, [attribute(0x80, runs=b"\x11\x01\x0a\0", count=1, size=-(-clusters // 8))])
    disk[12 * cluster : 14 * cluster] = b"\xff" * 2 * cluster
    for i in range(used):
        disk[10 * cluster + i // 8] |= 1 << i % 8
    return bytes(disk)


def vhdx(disk: bytes, block: int = 1 << 20, log: list[tuple[int, bytes]] | None = None) -> bytes:
    """A dynamic VHDX; log: sectors of 4096 bytes (offset, content) that only the log holds."""
    from strataspan.formats import vdisks

    n = -(-len(disk) // block)
    crc = lambda b: b[:4] + struct.pack("<I", checksums.crc32c(b[:4] + bytes(4) + b[8:])) + b[8:]
    guid = b"log-of-a-sample!" if log else bytes(16)
    out = bytearray(4 << 20)
    out[:8] = b"vhdxfile"
    for at, number in ((64 << 10, 1), (128 << 10, 2)):
        h = struct.pack("<4sIQ16s16s16sHHIQ", b"head", 0, number, bytes(16), bytes(16), guid, 0, 1, 1 << 20, 1 << 20)
        out[at : at + 4096] = crc(h.ljust(4096, b"\0"))
    table = struct.pack("<4sIII", b"regi", 0, 2, 0) + vdisks.BAT + struct.pack("<QII", 3 << 20, 1 << 20, 1) + vdisks.METADATA + struct.pack("<QII", 2 << 20, 1 << 20, 1)
    for at in (192 << 10, 256 << 10):
        out[at : at + (64 << 10)] = crc(table.ljust(64 << 10, b"\0"))
    items = [(vdisks.FILE_PARAMETERS, struct.pack("<II", block, 0)), (vdisks.DISK_SIZE, struct.pack("<Q", len(disk))), (vdisks.SECTOR, struct.pack("<I", 512))]
    meta, data = bytearray(struct.pack("<8sHH20x", b"metadata", 0, len(items))), b""
    for k, body in items:
        meta += k + struct.pack("<IIII", (64 << 10) + len(data), len(body), 4, 0)
        data += body
    out[2 << 20 : (2 << 20) + len(meta)] = meta
    out[(2 << 20) + (64 << 10) : (2 << 20) + (64 << 10) + len(data)] = data
    ratio = (1 << 23) * 512 // block
    for i in range(n):
        piece = disk[i * block : (i + 1) * block].ljust(block, b"\0")
        if any(piece):
            struct.pack_into("<Q", out, (3 << 20) + 8 * (i + i // ratio), len(out) | 6)
            out += piece
    if log:
        e = bytearray(struct.pack("<4sIIIQII16sQQ", b"loge", 0, 4096 * (1 + len(log)), 0, 9, len(log), 0, guid, len(out), len(out)))
        sectors = b""
        for at, body in log:
            e += struct.pack("<4s4s8sQQ", b"desc", body[4092:], body[:8], at, 9)
            sectors += struct.pack("<4sI", b"data", 0) + body[8:4092] + struct.pack("<I", 9)
        e = crc(bytes(e).ljust(4096, b"\0") + sectors)
        out[1 << 20 : (1 << 20) + len(e)] = e
    return bytes(out)
