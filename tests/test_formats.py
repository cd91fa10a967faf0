"""Readers on images made from rules; damage must end in Bad or Short, never in anything else."""

import bz2
import gzip
import io
import lzma
import random
import struct
import tarfile
import zipfile

import pytest
import zstandard

from strataspan.formats import bits, checksums, codecs, detect, layout, samples, schemes, signatures, smart, tar, vdisks
from strataspan.formats.reader import Bad, Chunks, Memory, Patched, Short

D = samples.reference()
CONTAINERS = {
    "vhd fixed": samples.vhd_fixed(D), "vhd dynamic": samples.vhd_dynamic(D), "qcow2": samples.qcow2(D), "qcow2 v2": samples.qcow2(D, version=2), "qcow2 packed": samples.qcow2(D, packed=True),
    "vmdk": samples.vmdk_sparse(D), "vmdk packed": samples.vmdk_sparse(D, True), "dmg zlib": samples.dmg(D), "dmg bzip2": samples.dmg(D, "bzip2"), "dmg raw": samples.dmg(D, "raw"),
    "vhdx": samples.vhdx(D),
}
STREAMS = {"gzip": gzip.compress(D) + gzip.compress(b"tail"), "bzip2": bz2.compress(D), "xz": lzma.compress(D), "zstd": zstandard.compress(D), "lzma": lzma.compress(D, lzma.FORMAT_ALONE)}
VOLUMES = {
    "fat12": samples.fat(12, 2000, [5, 6, 7, 100]), "fat16": samples.fat(16, 9000, [5, 100, 8000]), "fat32": samples.fat(32, 70000, [2, 5, 60000]), "swap": samples.swap(),
    "iso": samples.iso(), "ext2": samples.ext2(), "exfat": samples.exfat(), "ntfs": samples.ntfs(), "hfsplus": samples.hfsplus(),
    "lvm": samples.lvm({"root": samples.ext2(), "nested": samples.lvm({"in": samples.swap()}, extents=40)}, extents=180),
}


@pytest.mark.parametrize("name", CONTAINERS)
def test_container(name):
    s = Memory(CONTAINERS[name])
    out = b"".join(detect.raw_bytes(s))
    assert detect.kind_of(s) == name.split()[0]
    assert out[: len(D)] == D and not any(out[len(D) :]) and len(out) == detect.probe(s).uncompressed


@pytest.mark.parametrize("name", STREAMS)
def test_stream(name):
    s = Memory(STREAMS[name])
    assert detect.kind_of(s) == name
    assert b"".join(detect.raw_bytes(s)) == D + (b"tail" if name == "gzip" else b"")
    with pytest.raises(Bad):
        list(detect.raw_bytes(Memory(STREAMS[name][: len(STREAMS[name]) // 2])))


def test_zip_and_tar():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("folder/", "")
        f.writestr("empty", "")
        f.writestr("disk.img", D)
    assert b"".join(detect.raw_bytes(Memory(z.getvalue()))) == D and detect.probe(Memory(z.getvalue())).uncompressed == len(D)
    for kind in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        t = io.BytesIO()
        with tarfile.open(fileobj=t, mode="w", format=kind) as f:
            f.addfile(tarfile.TarInfo("empty"))
            i = tarfile.TarInfo("x/" + "n" * (90 if kind == tarfile.USTAR_FORMAT else 150))
            i.size = len(D)
            f.addfile(i, io.BytesIO(D))
        s = Memory(t.getvalue())
        assert tar.first_file(s).name == i.name and b"".join(detect.raw_bytes(s)) == D
        assert b"".join(detect.raw_bytes(Memory(gzip.compress(t.getvalue())))) == D


def _seven(data, method, properties, pack, encoded=False):
    """An archive of an empty file and one with data, its header packed or not."""
    n = lambda v: bytes([v]) if v < 128 else b"\xf0" + struct.pack("<I", v)
    coder = lambda: bytes([1, (32 if properties else 0) | len(method)]) + method + (n(len(properties)) + properties if properties else b"")
    streams = lambda start, packed, size: b"\x06" + n(start) + b"\x01\x09" + n(packed) + b"\x00\x07\x0b\x01\x00" + coder() + b"\x0c" + n(size) + b"\x00"
    body = pack(data)
    header = b"\x01\x04" + streams(0, len(body), len(data)) + b"\x08\x0a\x01" + struct.pack("<I", 0) + b"\x00\x00" + b"\x05\x02\x0e\x01\x80\x00\x00"
    if encoded:
        extra = pack(header)
        header, body = b"\x17" + streams(len(body), len(extra), len(header)) + b"\x00", body + extra
    import zlib

    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + header


@pytest.mark.parametrize("encoded", [False, True])
def test_7z(encoded):
    import zlib

    one = {"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}
    two = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}
    raw = lambda f: lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[f])
    deflate = lambda d: (c := zlib.compressobj(6, zlib.DEFLATED, -15)).compress(d) + c.flush()
    kinds = [(b"\0", b"", bytes), (b"\x03\x01\x01", bytes([93]) + struct.pack("<I", 1 << 20), raw(one)), (b"\x21", bytes([16]), raw(two)), (b"\x04\x02\x02", b"", bz2.compress), (b"\x04\x01\x08", b"", deflate)]
    for method, properties, pack in kinds:
        s = Memory(_seven(D, method, properties, pack, encoded))
        assert detect.kind_of(s) == "7z" and detect.probe(s).uncompressed == len(D) and b"".join(detect.raw_bytes(s)) == D
    with pytest.raises(Bad, match="encrypted"):
        list(detect.raw_bytes(Memory(_seven(D, b"\x06\xf1\x07\x01", b"", bytes))))
    r, v = random.Random(1), _seven(D[:5000], b"\x21", bytes([16]), raw(two), encoded)
    for _ in range(60):
        b = bytearray(v)
        b[r.choice([r.randrange(40), len(b) - 1 - r.randrange(60)])] = r.randrange(256)
        try:
            list(detect.raw_bytes(Memory(bytes(b))))
        except (Bad, Short):
            pass


def _header(name, size, kind, extra=b""):
    h = bytearray(512)
    h[: len(name)], h[100:108], h[124:136], h[156:157], h[257:263] = name, b"0000644\0", b"%011o\0" % size, kind, b"ustar\0"
    h[386 : 386 + len(extra)] = extra
    h[148:156] = b"%06o\0 " % sum(h[:148] + b" " * 8 + h[156:])
    return bytes(h)


def test_sparse_tar():
    a, b = b"A" * 512, b"B" * 100
    pairs = b"".join(b"%011o\0%011o\0" % p for p in ((1024, 512), (5000, 100))).ljust(96, b"\0") + b"\0" + b"%011o\0" % 6000
    gnu = _header(b"s", 612, b"S", pairs) + a + b.ljust(512, b"\0") + bytes(1024)
    records = "".join(f"{len(r) + 4} {r}\n" for r in ("GNU.sparse.major=1", "GNU.sparse.minor=0", "GNU.sparse.name=real", "GNU.sparse.realsize=6000"))
    sizes = b"2\n1024\n512\n5000\n100\n".ljust(512, b"\0")
    pax = _header(b"p", len(records), b"x") + records.encode().ljust(512, b"\0") + _header(b"s", 512 + 612, b"0") + sizes + a + b.ljust(512, b"\0") + bytes(1024)
    want = bytes(1024) + a + bytes(5000 - 1536) + b + bytes(900)
    for raw, name in ((gnu, "s"), (pax, "real")):
        m = tar.first_file(Memory(raw))
        assert m.name == name and b"".join(tar.contents(Memory(raw), m)) == want


def test_tar_numbers():
    assert [tar.number(x) for x in (b"0000644\0", b"        ", b"\x80" + bytes(3) + (20 << 30).to_bytes(8, "big"), b"9")] == [420, None, 20 << 30, None]


def test_lz4():
    block = bytes([0x50]) + b"abcde"
    frame = lambda flags, body: struct.pack("<I", codecs.LZ4) + (h := bytes([flags, 0x40])) + bytes([checksums.xxh32(h) >> 8 & 255]) + body
    raw = frame(0x60, struct.pack("<I", len(block)) + block + bytes(4)) + frame(0x64, struct.pack("<I", 1 << 31 | 3) + b"xyz" + bytes(4) + struct.pack("<I", checksums.xxh32(b"xyz")))
    assert detect.kind_of(Memory(raw)) == "lz4" and b"".join(codecs.stream("lz4", Memory(raw))) == b"abcdexyz"
    assert codecs.unlz4_block(bytes([0x14]) + b"a" + b"\x01\x00" + bytes([0x10]) + b"b", b"", 99) == b"a" + b"a" * 8 + b"b"
    with pytest.raises(Bad):
        list(codecs.stream("lz4", Memory(raw[:-1] + b"?")))


def test_checksums():
    n = b"123456789"
    assert [checksums.crc32(n), checksums.crc32c(n), checksums.crc16(0, n), checksums.crc_itu(n)] == [0xCBF43926, 0xE3069283, 0xBB3D, 0x31C3]
    assert [checksums.xxh64(x) for x in (b"", b"a", b"abc")] == [0xEF46DB3751D8E999, 0xD24EC4F1A98C6E5B, 0x44BC2CF5AD770999]
    assert codecs.unadc(bytes.fromhex("826162630c02400000"), 99) == b"abcabcabccccc"
    long = samples.Noise(8).bytes(40_999)
    for f in (checksums.crc32c, lambda b, seed=0: checksums.crc16(seed, b)):  # long data in stretches, short data byte by byte
        r = 0
        for k in range(0, len(long), 700):
            r = f(long[k : k + 700], r)
        assert f(long) == r


def test_bit_runs_against_a_scan():
    r = random.Random(5)
    for _ in range(200):
        data, base = bytes(r.choice([0, 255, r.randrange(256)]) for _ in range(r.randrange(40))), r.randrange(1000)
        n, msb, inv = r.randrange(8 * len(data) + 1), r.random() < 0.5, r.random() < 0.5
        bit = [(data[i // 8] >> (7 - i % 8 if msb else i % 8) & 1) ^ inv for i in range(n)]
        want, i = [], 0
        while i < n:
            j = i
            while j < n and bit[j]:
                j += 1
            if j > i:
                want.append((base + i, j - i))
            i = max(j, i + 1)
        assert bits.bit_runs(data, n, base, msb, inv) == want
    assert bits.bit_runs(b"\x06", 8, 1000) == [(1001, 2)]


def check(found: layout.Layout):
    """What holds for any layout, of damaged drives too."""
    last = -(1 << 20)
    for s, e in found.extents:
        assert 0 <= s < e <= found.size and s % 4096 == 0 and (e % 4096 == 0 or e == found.size) and s - last >= 65_536
        last = e
    assert len(found.extents) <= 65_536
    for p in found.partitions:
        assert 0 <= p.used <= p.size and (p.understood or p.used == p.size)


def test_layouts():
    fat, ext = VOLUMES["fat16"], VOLUMES["ext2"]
    for disk, table in ((samples.gpt([(2048, 22048), (30000, 40000)], 32 << 20, [fat, ext]), "gpt"), (samples.mbr([(0x0E, 2048, 20000), (0x83, 30000, 10000)], 32 << 20, [fat, ext]), "mbr")):
        found = layout.analyze(Memory(disk))
        check(found)
        assert found.table == table and [(p.index, p.fs, p.label, p.understood) for p in found.partitions] == [(1, "vfat", "SAMPLE", True), (2, "ext2", "sample", True)]
        assert found.used < found.size // 2
    damaged = bytearray(disk)
    damaged[30000 * 512 + 1024 + 0x3A] = 2  # not clean: kept whole when copied, believed when estimated
    assert not layout.analyze(Memory(damaged)).partitions[1].understood and layout.analyze(Memory(damaged), "estimate").partitions[1].understood


@pytest.mark.parametrize("name", VOLUMES)
def test_smart_copy_keeps_all_that_is_used(name):
    """A copy of the used ranges onto junk must read the same; without its largest range it must not."""
    v = VOLUMES[name]
    found = layout.analyze(Memory(v))
    check(found)
    assert found.partitions[0].understood, found.partitions[0].why

    def onto_junk(extents):
        out = bytearray(b"\xa5" * len(v))
        for s, e in extents:
            out[s:e] = v[s:e]
        return out

    again = layout.analyze(Memory(onto_junk(found.extents)))
    assert again.extents == found.extents and again.partitions[0].understood
    head = max(found.extents, key=lambda x: x[1] - x[0])
    if head[0] == 0:
        worse = layout.analyze(Memory(onto_junk([x for x in found.extents if x != head])))
        assert not worse.partitions[0].understood or worse.extents != found.extents


def test_fat_marks_each_cluster():
    for n, per in ((12, 2), (16, 2), (32, 4)):
        used = {"12": [5, 6, 7, 100], "16": [5, 100, 8000], "32": [2, 5, 60000]}[str(n)]
        v = VOLUMES[f"fat{n}"]
        usage = layout.examine(Memory(v), "copy")[2]
        data = usage.used[0][1]
        got = {2 + (x - data) // 512 for s, e in usage.used[1:] for x in range(s, e, 512)}
        assert got == set(used) and per


def test_lvm_maps_back():
    v = VOLUMES["lvm"]
    usage = layout.examine(Memory(v), "copy")[2]
    ext, start = samples.ext2(), 1 << 20
    inner = layout.examine(Memory(ext), "copy")[2]
    half = (len(ext) // 65536) // 2 * 65536
    for s, e in inner.used:  # the volume's two pieces stand 2 and 2 + half + 3 extents into the data
        for at in range(s, e, 512):
            place = start + 2 * 65536 + at + (3 * 65536 if at >= half else 0)
            assert any(a <= place < b for a, b in usage.used)


def test_lvm_text():
    from strataspan.formats.filesystems import lvm

    top = lvm.parse(b'vg1{seqno=7 # c\n id="a\\"b" list=["x",1, -2,[ ]] in { k = 1.5 } }')
    vg = top.sections[0]
    assert (vg.name, vg.number("seqno"), vg.text("id"), vg.values["list"], vg.sections[0].values) == ("vg1", 7, 'a"b', ["x", 1, None, []], {"k": None})
    for bad in (b"a {", b"a }", b"a = ", b'a = "x', b"= 1", b"a = [1 2]", b"a 1"):
        with pytest.raises(Bad):
            lvm.parse(bad)


def test_xfs_free_space():
    """A version 4 volume of one group: blocks 100 to 200 and 300 on are free."""
    block, n = 4096, 1024
    disk = bytearray(n * block)
    struct.pack_into(">4sIQQQ", disk, 0, b"XFSB", block, n, 0, 0)
    struct.pack_into(">QQ", disk, 48, 512, 0)
    struct.pack_into(">III", disk, 84, n, 1, 0)
    struct.pack_into(">IHH", disk, 96, 64, 4 | 0x2000 | 0x1000 | 0x0400, 512)
    disk[108:112], disk[120], disk[121], disk[124] = b"name", 12, 9, 10
    free = [(100, 100), (300, 212), (576, n - 576)]
    total = sum(c for _, c in free)
    struct.pack_into(">4sIIIIIIIIIIIII", disk, 512, b"XAGF", 1, 0, n, 1, 2, 0, 1, 1, 0, 0, 0, 0, total)
    struct.pack_into(">4sIII", disk, 1024, b"XAGI", 1, 0, n)
    for at, magic, records in ((1, b"ABTB", free), (2, b"ABTC", sorted(free, key=lambda r: r[1]))):
        struct.pack_into(">4sHHII", disk, at * block, magic, 0, len(records), 0xFFFFFFFF, 0xFFFFFFFF)
        for i, r in enumerate(records):
            struct.pack_into(">II", disk, at * block + 16 + 8 * i, *r)
    log = 512 * block
    for b in range(512):
        struct.pack_into(">I", disk, log + 512 * b, 1 if b >= 2 else 2)
    struct.pack_into(">4I", disk, log, 0xFEEDBABE, 2, 2, 512)
    struct.pack_into(">I", disk, log + 40, 1)
    disk[log + 512 + 8], disk[log + 512 + 9] = 0xAA, 0x20
    name, label, usage, why = layout.examine(Memory(disk), "copy")
    assert (name, label, why) == ("xfs", "name", None)
    assert bits.merge(usage.used) == [(0, 100 * block), (200 * block, 300 * block), (512 * block, 576 * block)]
    dirty = bytearray(disk)
    dirty[log + 512 + 9] = 0
    assert layout.examine(Memory(dirty), "copy")[3] == "log not clean (no unmount record)" and layout.examine(Memory(dirty), "estimate")[2]
    dirty = bytearray(disk)
    struct.pack_into(">I", dirty, 512 + 52, 5)
    assert "free block count" in layout.examine(Memory(dirty), "copy")[3]
    r = random.Random(4)
    for _ in range(60):
        b = bytearray(disk)
        for _ in range(3):
            b[r.choice([r.randrange(512), 512 + r.randrange(1024), block + r.randrange(200), log + r.randrange(2000)])] = r.randrange(256)
        check(layout.analyze(Memory(b)))


def _tag(kind, at, body, size=2048):
    d = bytearray(size)
    d[16 : 16 + len(body)] = body
    n = len(body)
    struct.pack_into("<HHBBHHHI", d, 0, kind, 2, 0, 0, 1, checksums.crc_itu(bytes(d[16 : 16 + n])), n, at)
    d[4] = (sum(d[:16]) - d[4]) & 255
    return d


def _udf(table=False):
    block, blocks, start, count = 2048, 800, 300, 400
    disk = bytearray(block * blocks)
    disk[0x8801:0x8806] = b"NSR02"
    put = lambda at, d: disk.__setitem__(slice(at * block, at * block + len(d)), d)
    put(256, _tag(2, 256, struct.pack("<IIII", 16 * block, 260, 0, 0)))
    pd = bytearray(512 - 16)
    struct.pack_into("<I", pd, 0, 1)
    pd[9:15] = b"+NSR02"
    struct.pack_into("<II", pd, 40 if table else 48, block, 5)
    struct.pack_into("<III", pd, 168, 4, start, count)
    lvd = bytearray(512 - 16)
    lvd[68:76] = b"\x08Disc\0\0\0"
    lvd[195] = 5
    struct.pack_into("<I", lvd, 196, block)
    struct.pack_into("<II", lvd, 248, 6, 1)
    struct.pack_into("<II", lvd, 416, block, 280)
    lvd[424:426] = b"\x01\x06"
    put(260, _tag(5, 260, pd))
    put(261, _tag(6, 261, lvd))
    put(262, _tag(8, 262, b""))
    free = [(10, 50), (200, 400)]
    n = sum(e - s for s, e in free)
    put(280, _tag(9, 280, bytes(12) + struct.pack("<I", 1) + bytes(40) + struct.pack("<III", 1, 0, n)))
    if table:
        ads = b"".join(struct.pack("<II", (e - s) * block, s) for s, e in free)
        put(start + 5, _tag(263, 5, bytes(20) + struct.pack("<I", len(ads)) + ads))
    else:
        raw = bytearray(-(-count // 8))
        for s, e in free:
            for b in range(s, e):
                raw[b // 8] |= 1 << b % 8
        put(start + 5, _tag(264, 5, struct.pack("<II", count, len(raw)) + raw))
    return bytes(disk), [(0, (start + 10) * block), ((start + 50) * block, (start + 200) * block)]


@pytest.mark.parametrize("table", [False, True])
def test_udf(table):
    disk, want = _udf(table)
    name, label, usage, why = layout.examine(Memory(disk), "copy")
    assert (name, label, why) == ("udf", "Disc", None) and bits.merge(usage.used) == want and usage.end == 700 * 2048
    r = random.Random(table)
    for _ in range(60):
        b = bytearray(disk)
        for at in (256, 260, 261, 280, 305):
            if r.random() < 0.4:
                b[at * 2048 + r.randrange(300)] = r.randrange(256)
        check(layout.analyze(Memory(b)))


def test_f2fs():
    block, seg = 4096, 512
    counts, places, at = [2, 2, 2, 1, 3], [], 512
    for n in counts:
        places.append(at)
        at += n * seg
    disk = bytearray(at * block)
    sb = bytearray(3072)
    struct.pack_into("<I4xIIII", sb, 0, 0xF2F52010, 9, 3, 12, 9)
    struct.pack_into("<Q4xI5II5I", sb, 36, at, sum(counts), *counts, 512, *places)
    sb[124:132] = "disk".encode("utf-16-le")
    disk[1024:4096] = disk[block + 1024 : 2 * block] = sb
    cp, sit, _, _, main = places
    h = bytearray(block)
    struct.pack_into("<Q8xQ", h, 0, 9, 3 + 512)
    struct.pack_into("<I", h, 40, 0)
    struct.pack_into("<H", h, 70, 512)
    struct.pack_into("<IIII", h, 132, 1, 10, 1, 0)
    struct.pack_into("<III", h, 156, seg // 8, 0, 4092)
    struct.pack_into("<I", h, 4092, checksums.crc32_raw(0xF2F52010, bytes(h[:4092])))
    for place in (cp, cp + 9):
        disk[place * block : (place + 1) * block] = h
    entry = lambda runs: struct.pack("<H", sum(n for _, n in runs)) + int("".join("1" if any(s <= i < s + n for s, n in runs) else "0" for i in range(512)), 2).to_bytes(64, "big") + bytes(8)
    raw = entry([(5, 3)]) + entry([(0, 9)])
    disk[sit * block : sit * block + len(raw)] = raw
    journal = (cp + 10 - 7 + 2) * block + 512 * 7  # segment 1 is full by the journal, whatever the table says
    disk[journal : journal + 80] = struct.pack("<HI", 1, 1) + entry([(0, 512)])
    name, label, usage, why = layout.examine(Memory(disk), "copy")
    assert (name, label, why) == ("f2fs", "disk", None)
    assert bits.merge(usage.used) == [(0, main * block), ((main + 5) * block, (main + 8) * block), ((main + 512) * block, (main + 1024) * block)]
    dirty = bytearray(disk)
    dirty[sit * block] = 4
    assert layout.examine(Memory(dirty), "copy")[3] == "SIT entry count mismatch"


def test_btrfs():
    """One system, one metadata and one data chunk; the data chunk holds two extents."""
    sec, node, size = 4096, 16384, 32 << 20
    fsid, gen, disk = bytes(range(16)), 5, bytearray(size)
    chunks = [(16 << 20, 1 << 20, 2, 2 << 20), (32 << 20, 4 << 20, 4, 4 << 20), (64 << 20, 8 << 20, 1, 10 << 20)]
    item = lambda n, kind, at: struct.pack("<QQQQIIIHH", n, 2, 65536, kind, sec, sec, sec, 1, 0) + struct.pack("<QQ16s", 1, at, bytes(16))
    extents = [(64 << 20, 8192), ((64 << 20) + 65536, 4096)]
    roots = {1: (32 << 20), 2: (32 << 20) + node, 3: 16 << 20}

    def leaf(owner, items):
        b, end = bytearray(node), node - 101
        struct.pack_into("<16sQQ16sQQIB", b, 0x20, fsid, roots[owner], 1, bytes(16), gen, owner, len(items), 0)
        for i, ((a, kind, c), d) in enumerate(sorted(items)):
            end -= len(d)
            struct.pack_into("<QBQII", b, 101 + 25 * i, a, kind, c, end, len(d))
            b[101 + end : 101 + end + len(d)] = d
        struct.pack_into("<I", b, 0, checksums.crc32c(bytes(b[32:])))
        logical, _, _, at = next(c for c in chunks if c[0] <= roots[owner] < c[0] + c[1])
        disk[at + roots[owner] - logical : at + roots[owner] - logical + node] = b

    root = bytearray(439)
    struct.pack_into("<QQQ", root, 160, gen, 0, roots[2])
    used = {2: node, 4: 2 * node, 1: 12288}
    leaf(3, [((256, 228, a), item(n, k, at)) for a, n, k, at in chunks])
    leaf(1, [((2, 132, 0), bytes(root))])
    leaf(2, [((a, 192, n), struct.pack("<QQQ", used[k], 256, k)) for a, n, k, _ in chunks] + [((a, 168, n), bytes(24)) for a, n in extents] + [((roots[2], 169, 0), bytes(24))])
    sb = bytearray(4096)
    array = struct.pack("<QBQ", 256, 228, chunks[0][0]) + item(*(chunks[0][1], 2, chunks[0][3]))
    struct.pack_into("<16sQQ8sQQQQ8xQQQQQIIII", sb, 0x20, fsid, 65536, 0, b"_BHRfS_M", gen, roots[1], roots[3], 0, size, sum(used.values()), 6, 1, 0, sec, node, node, sec)
    struct.pack_into("<QQ", sb, 0x70, size, sum(used.values()))
    struct.pack_into("<QQ", sb, 0x80, 6, 1)
    struct.pack_into("<IIIIIQ", sb, 0x90, sec, node, node, sec, len(array), gen)
    struct.pack_into("<QQQ", sb, 0xAC, 0, 0, 0)
    struct.pack_into("<QQ", sb, 0xC9, 1, size)
    sb[0x12B:0x12F], sb[0x32B : 0x32B + len(array)] = b"data", array
    struct.pack_into("<I", sb, 0, checksums.crc32c(bytes(sb[32:])))
    disk[65536 : 65536 + 4096] = sb
    name, label, usage, why = layout.examine(Memory(disk), "copy")
    assert (name, label, why) == ("btrfs", "data", None)
    at = 10 << 20
    assert bits.merge(usage.used) == [(0, 1 << 20), (2 << 20, 3 << 20), (4 << 20, 8 << 20), (at, at + 8192), (at + 65536, at + 69632)]
    for place, why in ((65536 + 300, "superblock checksum mismatch"), ((2 << 20) + 200, "tree block checksum mismatch")):
        bad = bytearray(disk)
        bad[place] ^= 1
        assert layout.examine(Memory(bad), "copy")[3] == why


def test_apfs():
    """A container of one chunk: checkpoint areas, space manager, object map and one volume; blocks 40 to 59 hold files."""
    bs, n, xid = 4096, 256, 4
    disk = bytearray(bs * n)

    def put(at, oid, kind, subtype, body):
        o = bytearray(bs)
        struct.pack_into("<QQII", o, 8, oid, xid, kind, subtype)
        o[32 : 32 + len(body)] = body
        struct.pack_into("<Q", o, 0, checksums.fletcher64(bytes(o[8:])))
        disk[at * bs : (at + 1) * bs] = o

    sb = bytearray(bs - 32)
    w = lambda at, *v: struct.pack_into("<" + "Q" * len(v), sb, at - 32, *v)
    sb[:4] = b"NXSB"
    struct.pack_into("<I", sb, 4, bs)
    w(0x28, n)
    w(0x40, 2)
    struct.pack_into("<II", sb, 0x68 - 32, 4, 6)
    w(0x70, 1, 5)
    struct.pack_into("<I", sb, 0x8C - 32, 2)
    w(0x98, 1024, 20)
    w(0xB8, 1026)
    put(0, 1, 1 | 0x80000000, 0, sb)
    put(2, 1, 1 | 0x80000000, 0, sb)
    put(1, 1, 0xC | 0x40000000, 0, struct.pack("<II", 1, 1) + struct.pack("<IIIIQQQ", 5 | 0x80000000, 0, bs, 0, 0, 1024, 5))
    taken = [*range(11), *range(20, 24), *range(40, 60)]
    sm = bytearray(bs - 32)
    struct.pack_into("<IIII", sm, 0, bs, 8 * bs, (bs - 0x28) // 32, (bs - 0x28) // 8)
    struct.pack_into("<QQIIQ", sm, 0x30 - 32, n, 1, 1, 0, n - len(taken))
    struct.pack_into("<I", sm, 0x50 - 32, 0x200)
    struct.pack_into("<QIIQQ", sm, 0x98 - 32, 3, 0, 1, 24, 12)
    struct.pack_into("<Q", sm, 0x200 - 32, 12)
    put(5, 1024, 5 | 0x80000000, 0, sm)
    put(12, 12, 7 | 0x40000000, 0, struct.pack("<II", 0, 1) + struct.pack("<QQIIQ", xid, 0, n, n - len(taken), 13))
    bitmap = bytearray(bs)
    for b in taken:
        bitmap[b // 8] |= 1 << b % 8
    disk[13 * bs : 14 * bs] = bitmap
    omap = bytearray(bs - 32)
    struct.pack_into("<I", omap, 8, 2 | 0x40000000)
    struct.pack_into("<Q", omap, 16, 21)
    put(20, 20, 0xB | 0x40000000, 0, omap)
    tree = bytearray(bs - 32)
    struct.pack_into("<HHIHHHH", tree, 0, 7, 0, 1, 0, 64, 64, bs - 0x38 - 128 - 40 - 16)
    struct.pack_into("<HH", tree, 0x38 - 32, 0, 16)
    struct.pack_into("<QQ", tree, 0x38 - 32 + 64, 1026, xid)
    struct.pack_into("<IIQ", tree, bs - 32 - 40 - 16, 0, bs, 22)
    struct.pack_into("<IIII", tree, bs - 32 - 40, 0, bs, 16, 16)
    put(21, 21, 2 | 0x40000000, 0xB, tree)
    vol = bytearray(bs - 32)
    vol[:4] = b"APSB"
    vol[0x2C0 - 32 : 0x2C0 - 27] = b"Files"
    put(22, 1026, 0xD, 0, vol)
    name, label, usage, why = layout.examine(Memory(disk), "copy")
    assert (name, label, why) == ("apfs", "Files", None)
    assert bits.merge(usage.used) == [(0, 11 * bs), (12 * bs, 15 * bs), (20 * bs, 25 * bs), (40 * bs, 60 * bs)]
    bad = bytearray(disk)
    bad[13 * bs + 9] ^= 1
    assert layout.examine(Memory(bad), "copy")[3] == "a bitmap disagrees with its free count"
    r = random.Random(6)
    for _ in range(60):
        bad = bytearray(disk)
        bad[r.choice([0, 1, 2, 5, 12, 20, 21, 22]) * bs + r.randrange(700)] ^= r.randrange(1, 256)
        check(layout.analyze(Memory(bad)))


def test_extended_chain():
    disk = bytearray(8 << 20)
    put = lambda at, i, kind, first, n: struct.pack_into("<B3xB3xII", disk, at + 0x1BE + 16 * i, 0, kind, first, n)
    put(0, 0, 0x83, 64, 100)
    put(0, 1, 0x05, 1000, 9000)
    put(1000 * 512, 0, 0x83, 10, 50)
    put(1000 * 512, 1, 0x05, 500, 400)
    put(1500 * 512, 0, 0x83, 10, 60)
    put(1500 * 512, 1, 0x05, 0, 400)  # back to the first: the walk ends
    for at in (0, 1000 * 512, 1500 * 512):
        disk[at + 510 : at + 512] = b"\x55\xaa"
    found = schemes.read(Memory(disk))
    assert [i for i, *_ in found.slots] == [1, 5, 6] and found.slots[1] == (5, 1010 * 512, 50 * 512)


def test_apple_map():
    disk = bytearray(4 << 20)
    disk[:4] = b"ER\x02\x00"
    for k, (kind, first, n) in enumerate([(b"Apple_partition_map", 1, 63), (b"Apple_HFS", 64, 2000), (b"Apple_Free", 2064, 6000)]):
        o = 512 * (k + 1)
        disk[o : o + 2] = b"PM"
        struct.pack_into(">III", disk, o + 4, 3, first, n)
        disk[o + 48 : o + 48 + len(kind)] = kind
    found = schemes.read(Memory(disk))
    assert found.table == "apm" and found.slots == [(2, 64 * 512, 2000 * 512)] and (512, 64 * 512) in found.fixed


def test_bsd_label():
    disk = bytearray(samples.mbr([(0xA5, 64, 8000)], 8 << 20, [b""]))
    label = bytearray(148 + 16 * 4)
    struct.pack_into("<I", label, 0, schemes.BSD_MAGIC)
    struct.pack_into("<I", label, 132, schemes.BSD_MAGIC)
    struct.pack_into("<I", label, 40, 512)
    struct.pack_into("<H", label, 138, 4)
    for i, (n, start, kind) in enumerate([(1000, 16, 7), (2000, 2000, 1), (8000, 0, 0), (0, 0, 0)]):
        struct.pack_into("<IIIB", label, 148 + 16 * i, n, start, 0, kind)
    struct.pack_into("<H", label, 136, checksums.xor16(bytes(label)))
    disk[65 * 512 : 65 * 512 + len(label)] = label
    found = schemes.read(Memory(disk))
    assert found.slots == [(5, 80 * 512, 1000 * 512), (6, 2064 * 512, 2000 * 512)]


def test_signatures():
    h = lambda at, raw, n=signatures.HEAD: bytes(at) + raw + bytes(n - at - len(raw))
    for name, at, raw in (("crypto_LUKS", 0, b"LUKS\xba\xbe"), ("jfs", 0x8000, b"JFS1"), ("xfs", 0, b"XFSB"), ("btrfs", 0x10040, b"_BHRfS_M"), ("hfsplus", 1024, b"H+\0\x04"), ("squashfs", 0, b"hsqs")):
        assert signatures.detect(h(at, raw)) == [name]
        found = layout.examine(Memory(h(at, raw)), "copy")
        assert found[0] == name and found[2] is None
    assert layout.examine(Memory(h(0, b"XFSB")[:0x10040] + b"_BHRfS_M" + bytes(100)), "copy")[3].startswith("ambiguous")


@pytest.mark.parametrize("name", VOLUMES)
def test_damaged_volumes(name):
    r, v = random.Random(name), VOLUMES[name]
    for _ in range(40):
        b = bytearray(v)
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(min(len(b), r.choice([512, 4096, 70_000])))
            b[at] = r.choice([0, 255, r.randrange(256)])
        check(layout.analyze(Memory(b)))


@pytest.mark.parametrize("name", CONTAINERS)
def test_damaged_containers(name):
    r, v = random.Random(name), CONTAINERS[name]
    for _ in range(25):
        b = bytearray(v)
        for _ in range(r.randrange(1, 5)):
            at = r.choice([r.randrange(600), len(b) - 1 - r.randrange(900), r.randrange(len(b))]) % len(b)
            b[at] = r.randrange(256)
        try:
            for piece in detect.raw_bytes(Memory(bytes(b))):
                assert len(piece) <= 256 << 20
                break
        except (Bad, Short):
            pass


def test_damaged_tables():
    r = random.Random(1)
    disk = samples.gpt([(64, 1000), (2000, 5000)], 4 << 20, [VOLUMES["fat12"][:100_000], b""])
    parsed = 0
    for _ in range(150):
        b = bytearray(disk)
        for _ in range(r.randrange(4)):
            b[r.choice([r.randrange(512), 512 + r.randrange(600), len(b) - 1 - r.randrange(600)])] = r.randrange(256)
        found = layout.analyze(Memory(b))
        check(found)
        parsed += found.table == "gpt"
    assert parsed > 30


def test_smart_maps():
    size, ext = 64 * (1 << 20) + 1536, [(0, 1 << 20), (3 << 20, (3 << 20) + 8192), (8 << 20, 17 << 20), (40 << 20, (40 << 20) + 4096), (64 * (1 << 20) + 1536 - 5632, 64 * (1 << 20) + 1536)]
    text = smart.to_text(size, ext)
    assert smart.parse(text.encode()) == (size, ext) and smart.parse(b"else\n") is None
    for bad in (text.replace("extents=5", "extents=4"), text.replace("used=", "used=1"), text.replace("map=", "map=!"), text[:-9]):
        with pytest.raises(Bad):
            smart.parse(bad.encode())
    many = [(i * 100 * 4096, i * 100 * 4096 + 40_960) for i in range(100_000)]
    assert len(smart.to_text(1 << 40, many)) < 300_000
    assert len(smart.zeros_frame(64 << 20)) < 4096
    assert smart.read_seek_table(Memory(b"x" * 9 + smart.seek_table([(300, 0), (1234, 4 << 20), (2000, 64 << 20)]))) == ([(300, 0), (1234, 4 << 20), (2000, 64 << 20)], 9)


def test_gzip_member_header():
    h = b"\x1f\x8b\x08\x14" + bytes(6) + struct.pack("<H2sHII", 12, b"DG", 8, 500, 900) + b"a comment\0"
    assert smart.gzip_header(Memory(h + b"\x03\0"), 0) == (len(h), (500, 900), b"a comment")


def test_vhdx_log_is_replayed():
    plain = samples.vhdx(D)
    place = len(plain) - (1 << 20)  # within the last block
    before, new = plain[place : place + 4096], bytes(range(256)) * 16
    logged = Memory(samples.vhdx(D, log=[(place, new)]))
    out = b"".join(detect.raw_bytes(logged))
    at = (len(out) - 1) // (1 << 20) * (1 << 20)
    assert out[at : at + 4096] == new and before != new and out[:at] == D[:at]


def test_ntfs():
    usage = layout.examine(Memory(samples.ntfs()), "copy")[2]
    assert bits.merge(usage.used) == [(0, 30 * 4096)] and usage.label == "SAMPLE"
    assert layout.examine(Memory(samples.ntfs(dirty=True)), "copy")[3].startswith("volume marked dirty")
    torn = bytearray(samples.ntfs())
    torn[4 * 4096 + 3 * 1024 + 510] ^= 1
    assert layout.examine(Memory(torn), "copy")[3] == "torn write in a metadata record"


def test_smart_v1():
    used = [(0, 8192), (1 << 20, (1 << 20) + 4096)]
    raw = samples.smart_v1(D, used)
    s = Memory(raw)
    assert (detect.probe(s).format, detect.probe(s).smart_size, detect.probe(s).smart_used) == ("gzip", len(D), 12288)
    whole = b"".join(detect.raw_bytes(s))
    assert len(whole) == len(D) and all(whole[a:b] == D[a:b] for a, b in used)
    size, extents, members = smart.members(s)
    assert (size, extents) == (len(D), used) and sum(bool(smart.wanted(m, extents)) for m in members) == 2
    assert all(len(smart.inflate(s.read(m.offset, m.packed), m.length)) == m.length for m in members)


def test_overlays():
    s = Patched(Memory(b"0123456789"), [(2, 3, b"abc"), (4, 4, None)], 12)
    assert s.read(0, 12) == b"01ab\0\0\0\x0089\0\0"
    assert Chunks([(4, b"zz"), (0, b"aaaa")], 8).read(1, 7) == b"aaazz\0\0"


def test_dmg_checksums():
    s = Memory(CONTAINERS["dmg zlib"])
    k = vdisks.dmg_trailer(s)
    assert [ok for *_, ok in vdisks.dmg_sums(s, k, vdisks.open_dmg(s, k))] == [True]
