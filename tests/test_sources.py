"""Data sources, copy jobs, drive listings, plans and the stream of workers."""

import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from strataspan.formats import detect, layout, samples, smart
from strataspan.formats.reader import Bad, File, Memory
from strataspan.functions import binary
from strataspan.operators import copying
from strataspan.plans import image_queries, jobs
from strataspan.sources import disk_sources, drives
from strataspan.streaming import worker


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    disk = samples.mbr([(0x0E, 2048, 20000), (0x83, 30000, 10000)], 24 << 20, [samples.fat(16, 9000, [5, 100, 8000]), samples.ext2()])
    (folder / "disk.img").write_bytes(disk)
    (folder / "disk.qcow2").write_bytes(samples.qcow2(disk))
    (folder / "disk.vmdk").write_bytes(samples.vmdk_sparse(disk, True))
    return folder


def test_sources(spark, images):
    disk_sources.register(spark)
    read = lambda name, p, **o: spark.read.format(name).options(path=str(images / p), **o).load()
    want = layout.analyze(File(str(images / "disk.img")))
    assert {(r.start, r.end) for r in read("disk_layout", "disk.img", what="extents").collect()} == set(want.extents)
    assert [r.fs for r in read("disk_layout", "disk.img").orderBy("index").collect()] == ["vfat", "ext2"]
    assert {os.path.basename(r.image): r.format for r in read("image_headers", "disk.*").collect()} == {"disk.img": "raw", "disk.qcow2": "qcow2", "disk.vmdk": "vmdk"}
    pieces = read("image_pieces", "disk.qcow2").orderBy("pos").collect()
    assert sum(r.length for r in pieces) == 24 << 20 and all(a.pos + a.length == b.pos for a, b in zip(pieces, pieces[1:], strict=False))
    chunks = read("byte_chunks", "disk.img", chunk=1 << 20, split=4 << 20)
    some = read("byte_chunks", "disk.img", **{"chunk": 1 << 20, "split": 4 << 20, "from": 21 << 20, "to": 23 << 20})
    assert (chunks.count(), chunks.rdd.getNumPartitions(), some.rdd.getNumPartitions()) == (24, 6, 1) and {r.pos for r in some.collect()} == {21 << 20, 22 << 20}
    assert b"".join(bytes(r.bytes) for r in chunks.orderBy("pos").collect()) == (images / "disk.img").read_bytes()
    with pytest.raises(Exception, match="no image matches"):
        read("disk_layout", "none*").count()


def test_byte_chunks_query_has_every_chunk(spark, sf):
    out = {(r.image, r.pos): r.crc for r in image_queries.byte_chunks(spark, sf).collect()}
    want = {(n, at): zlib.crc32(b[at : at + (1 << 20)]) for n, b in image_queries.disks().items() for at in range(0, len(b), 1 << 20)}
    assert out == want and max(at for _, at in out) == 31 << 20


@pytest.mark.parametrize("name", ["disk.qcow2", "disk.vmdk", "disk.img"])
def test_restore(spark, images, tmp_path, name):
    size = copying.restore(spark, str(images / name), str(tmp_path / "out.img"))
    assert size == 24 << 20 and (tmp_path / "out.img").read_bytes() == (images / "disk.img").read_bytes()
    (tmp_path / "small.img").write_bytes(bytes(1 << 20))
    with pytest.raises(Bad, match="doesn't fit"):
        copying.restore(spark, str(images / name), str(tmp_path / "small.img"))


def test_backup_and_back(spark, images, tmp_path):
    source, target = str(images / "disk.img"), str(tmp_path / "disk.zst")
    info = copying.backup(spark, source, target, f"file://{tmp_path}")
    raw, used = (images / "disk.img").read_bytes(), layout.analyze(File(source)).extents
    assert info["used"] == sum(e - s for s, e in used)
    whole = b"".join(detect.raw_bytes(File(target)))  # any zstd reader gives the drive, free space as zeros
    assert len(whole) == len(raw) and all(whole[s:e] == raw[s:e] for s, e in used)
    i = detect.probe(File(target))
    assert (i.format, i.smart_size, i.smart_used) == ("zstd", len(raw), info["used"])
    junk = tmp_path / "junk.img"
    junk.write_bytes(b"\xa5" * len(raw))
    copying.restore(spark, target, str(junk))
    out = junk.read_bytes()
    assert all(out[s:e] == raw[s:e] for s, e in used) and set(out[used[0][1] : used[1][0]]) <= {0xA5}
    broken = bytearray((tmp_path / "disk.zst").read_bytes())
    broken[-12] ^= 1
    with pytest.raises(Bad):
        smart.frames(Memory(bytes(broken)))


def test_restore_version_1(spark, tmp_path):
    disk = samples.reference()
    used = [(0, 8192), (1 << 20, (1 << 20) + 4096)]
    (tmp_path / "old.gz").write_bytes(samples.smart_v1(disk, used))
    (tmp_path / "out.img").write_bytes(b"\xa5" * len(disk))
    assert copying.restore(spark, str(tmp_path / "old.gz"), str(tmp_path / "out.img")) == len(disk)
    out = (tmp_path / "out.img").read_bytes()
    assert all(out[a:b] == disk[a:b] for a, b in used) and set(out[8192 : 1 << 20]) == {0xA5}


def test_in_place_copy_and_zeros(spark, images, tmp_path):
    source, target = str(images / "disk.img"), tmp_path / "t.img"
    target.write_bytes(b"\xa5" * (24 << 20))
    copying.copy_used(spark, source, str(target), [(4096, 8192), (5 << 20, 11 << 20)])
    raw, out = (images / "disk.img").read_bytes(), target.read_bytes()
    assert out[4096:8192] == raw[4096:8192] and out[5 << 20 : 11 << 20] == raw[5 << 20 : 11 << 20] and out[:4096] == b"\xa5" * 4096
    copying.write_zeros(spark, str(target), 9 << 20)
    assert not any(target.read_bytes()[: 9 << 20]) and len(target.read_bytes()) == 24 << 20


def test_byte_functions(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\xff"),), (bytearray(b""),)], "b binary")
    out = df.select(binary.be(F.col("b"), 0, 4).alias("be"), binary.le(4, 0)("b").alias("le"), binary.le(2, 4)("b").alias("short"), binary.magic(F.col("b"), 1, b"\x02\x03").alias("m")).collect()
    assert [tuple(r) for r in out] == [(0x01020304, 0x04030201, 0, True), (0, 0, 0, False)]
    z = spark.createDataFrame([("zlib", bytearray(b"junk"), 9), ("adc", bytearray(bytes.fromhex("826162630c02400000")), 99)], "c string, b binary, n int")
    assert [r[0] and bytes(r[0]) for r in z.select(binary.decode_block("c", "b", "n")).collect()] == [None, b"abcabcabccccc"]


def test_linux_drives(spark):
    from strataspan.plans.image_queries import LSBLK

    found = drives.parse_lsblk(json.dumps(LSBLK))
    assert [(d.name, d.kind, d.bus, d.removable, d.system, d.volumes) for d in found] == [("Quarry Q500", "Hdd", "SATA", False, True, ["root (ext4)"]), ("Harbour Pebble Mini", "Usb", "USB", True, False, ["FAT"])]
    card = {"name": "mmcblk0", "size": "8", "type": "disk", "children": [{"name": "p1", "mountpoints": [None, "[SWAP]"]}]}
    assert drives.parse_lsblk(json.dumps({"blockdevices": [card]}), lambda n: "MMC")[0].bus == "eMMC"
    (d,) = drives.parse_lsblk(json.dumps({"blockdevices": [card, {**card, "name": "mmcblk0boot0"}, {"name": "loop0", "type": "loop", "ro": True, "size": 9}]}))
    assert (d.bus, d.removable, d.system, d.unmount) == ("SD", True, True, [])
    rows = drives.drives_of(spark.createDataFrame([("h", "linux", json.dumps(LSBLK))], "host string, os string, listing string"))
    assert [r.path for r in drives.listed(rows).collect()] == ["/dev/sdb", "/dev/sda"]
    assert [(r.path, r.note) for r in drives.picked(rows, True, True).orderBy("path").collect()] == [("/dev/sda", "holds the operating system"), ("/dev/sdb", None)]


def test_mac_drives():
    listing = {"AllDisksAndPartitions": [
        {"DeviceIdentifier": "disk0", "Size": 500, "Partitions": [{"DeviceIdentifier": "disk0s2", "Content": "Apple_APFS"}]},
        {"DeviceIdentifier": "disk3", "APFSPhysicalStores": [{"DeviceIdentifier": "disk0s2"}], "APFSVolumes": [{"VolumeName": "Orchard", "MountedSnapshots": [{"SnapshotMountPoint": "/"}]}, {"VolumeName": "Cellar", "MountPoint": "/System/Volumes/Data"}]},
        {"DeviceIdentifier": "disk4", "Size": 64, "Content": "FDisk_partition_scheme", "Partitions": [{"VolumeName": "HOLIDAY", "Content": "DOS_FAT_32", "MountPoint": "/Volumes/HOLIDAY"}]},
    ]}
    info = {"disk0": {"Internal": True, "BusProtocol": "Apple Fabric", "MediaName": "Orchard SSD Media", "TotalSize": 0, "Size": "500"}, "disk4": {"Internal": True, "BusProtocol": "USB", "MediaName": "Built In SDXC Reader", "RemovableMedia": True, "WritableMedia": False}}
    a, b = drives.parse_diskutil(listing, info)
    assert (a.name, a.size, a.kind, a.system, a.volumes, a.unmount) == ("Orchard SSD", 500, "Ssd", True, ["Orchard (APFS)", "Cellar (APFS)"], ["/dev/disk3", "/dev/disk0"])
    assert (b.kind, b.bus, b.removable, b.system, b.read_only, b.volumes, b.io_path) == ("Sd", "SD", True, False, True, ["HOLIDAY (FAT32)"], "/dev/rdisk4")
    assert [drives.whole_disk(x) for x in ("disk4s2", "disk12", "nvme0")] == ["disk4", "disk12", "nvme0"]


def test_windows_drives():
    disks = [{"Number": 1, "Name": "Pebble USB Device", "Size": 16, "Bus": "7", "Volumes": {"value": [{"Letter": "e", "Label": "S", "FileSystem": "FAT32"}, {"Letter": "\0", "Guid": "\\\\?\\Volume{ab}\\", "Folders": ["C:\\m\\"]}, {}], "Count": 3}}, {"Number": None, "Size": 5}, {"Number": "2", "Size": 0}]
    (d,) = drives.parse_powershell("noise\r\n\ufeff" + json.dumps(disks))
    assert (d.name, d.kind, d.mountpoints, d.volumes, d.lock) == ("Pebble", "Usb", ["E:\\", "C:\\m\\"], ["S (FAT32)"], ["E:", "\\\\?\\Volume{ab}"])
    assert drives.parse_powershell(json.dumps(disks[0]))[0].path == "\\\\.\\PhysicalDrive1"
    assert drives.parse_powershell('{"value": [], "Count": 0}') == []
    with pytest.raises(ValueError):
        drives.parse_powershell("nothing")


def drive(path="/dev/sdb", size=32 * 10**9, **more):
    return drives.Drive(path, path, "Pebble", size, "USB", "Usb", True, more.pop("system", False), more.pop("read_only", False), **more)


def test_plans(tmp_path):
    raw = jobs.ImageFile("/img/a b.img", detect.Info("raw", 5 * 10**9, 5 * 10**9))
    xz = jobs.ImageFile("/img/a.xz", detect.Info("xz", 10**9, 40 * 10**9))
    p = jobs.Plan(raw, drive())
    assert p.command_line() == "dd if='/img/a b.img' of=/dev/sdb bs=4M oflag=direct status=progress && sync" and p.problem() is None and p.total == 5 * 10**9
    assert jobs.Plan(xz, drive()).command_line() == "xz -dc /img/a.xz | dd of=/dev/sdb bs=4M oflag=direct status=progress && sync"
    assert jobs.Plan(xz, drive()).obstacle() == ("too_large", "40.0 GB are needed and 32.0 GB are there.")
    assert jobs.Plan(jobs.ZEROS, drive()).command_line() == "dd if=/dev/zero of=/dev/sdb bs=16M count=32000000000 iflag=count_bytes oflag=direct status=progress && sync"
    assert jobs.Plan(drive(), "/img/o.img").command_line() == "dd if=/dev/sdb of=/img/o.img bs=4M iflag=direct conv=fsync,sparse status=progress"
    assert jobs.Plan(drive(), drive()).obstacle()[0] == "same_drive"
    assert jobs.Plan(raw, drive(system=True)).obstacle()[0] == "system" and jobs.Plan(raw, drive(read_only=True)).obstacle()[0] == "read_only"
    assert jobs.Plan(jobs.ZEROS, "/x").obstacle()[0] == "endless"
    assert [jobs.Plan(None, drive()).obstacle()[0], jobs.Plan(raw, None).obstacle()[0]] == ["no_source", "no_target"] and "read" in jobs.Plan(None, drive()).problem()
    assert jobs.Plan(raw, drive(), jobs.Options(skip=2, count=3, block_size=1 << 20)).total == 3 << 20
    assert jobs.Plan(xz, drive(), jobs.Options(count=1)).obstacle()[0] == "no_blocks"
    here = drive(mountpoints=[str(tmp_path)])
    assert jobs.Plan(here, str(tmp_path / "o.img"), drives=(drive("/dev/sda", mountpoints=["/"]),)).obstacle()[0] == "target_on_source"
    small = drive(size=5 * 10**9)  # the last block is filled up where errors are passed over
    assert jobs.Plan(raw, small).problem() is None and jobs.Plan(raw, small, jobs.Options(noerror=True)).obstacle()[0] == "too_large"
    assert jobs.Plan(raw, drive()).note() is None and "xz" in jobs.Plan(xz, drive()).note() and "packed" in jobs.Plan(xz, "/x").note()
    assert [jobs.Plan(a, b).action() for a, b in ((raw, drive()), (drive(), "/x"), (drive(), drive("/dev/c")), (jobs.ZEROS, drive()), (raw, "/x"), (jobs.ZEROS, "/x"), (None, None))] == ["Image to drive", "Drive to image", "Drive to drive", "Overwrite drive", "Duplicate image", "Make empty file", "Run"]
    assert [jobs.parse_size(t) for t in ("4M", "1GiB", "x", "99999999999T")] == [4 << 20, 1 << 30, None, None]
    assert jobs.quote("it's") == "'it'\\''s'" and jobs.short_path("/home/u/" + "d" * 60, "/home/u") == "~/" + "d" * 14 + "…" + "d" * 27


def test_status_lines(spark):
    lines = ["@ready", ' @layout {"a": 1}', "@total 100", "@progress 5 7\r", "@progress x", "@progress 9", "@sync", "other"]
    df = worker.parse_status(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.word, r.layout, r.total, r.done, r.written) for r in df.collect()] == [("@ready", None, None, None, None), ("@layout", '{"a": 1}', None, None, None), ("@total", None, 100, None, None), ("@progress", None, None, 5, 7), ("@progress", None, None, None, None), ("@progress", None, None, 9, None), ("@sync", None, None, None, None), ("other", None, None, None, None)]
    dd = ["7300 bytes (7.3 kB, 7.1 KiB) copied, 0.25 s, 29 kB/s", "7+1 records in", " dd: error ", ""]
    out = spark.createDataFrame([(x,) for x in dd], "l string").select(worker.dd_progress(F.col("l")), worker.dd_record_count(F.col("l")), worker.dd_message(F.col("l"))).collect()
    assert [tuple(r) for r in out] == [(7300, False, None), (None, True, None), (None, False, "dd: error"), (None, False, None)]


def test_job_progress_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    steps = ["@ready", "@layout {}", "@copy", "@total 1000", "@progress 0", "@progress 100", "@progress 500", "@progress 1000", "@sync"]
    times = ["00", "00", "01", "01", "01", "02", "03", "04", "05"]
    rows = [{"job": "a", "ts": f"2024-01-01T00:00:{t}Z", "seq": i, "line": s} for i, (s, t) in enumerate(zip(steps, times, strict=True))]
    rows += [{"job": "b", "ts": "2024-01-01T00:00:00Z", "seq": 0, "line": "@ready"}, {"job": "b", "ts": "2024-01-01T00:00:01Z", "seq": 1, "line": "@progress 3"}]
    for k, part in enumerate((rows[:6] + rows[9:], rows[6:9])):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    lines = spark.readStream.schema("job string, ts timestamp, seq long, line string").option("maxFilesPerTrigger", 1).json(str(folder))
    query = worker.job_progress(lines).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.job: r for r in spark.table("progress").orderBy("lines").collect()}
    a, b = last["a"], last["b"]
    assert (a.done, a.total, a.finished, a.order_ok, a.bars, a.bar) == (1000, 1000, True, True, 3, 500.0) and abs(a.rate - 1000 / 3) < 1e-6
    assert not b.order_ok and not b.finished


def test_worker_lines_source(spark, tmp_path):
    folder = tmp_path / "jobs"
    folder.mkdir()
    (folder / "j1").write_bytes(b"@ready\r@progress 1\r\n@progr")
    spark.dataSource.register(worker.WorkerLines)
    query = spark.readStream.format("worker_lines").option("path", str(folder)).load().writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.job, r.seq, r.line) for r in spark.table("lines").orderBy("seq").collect()] == [("j1", 0, "@ready"), ("j1", 7, "@progress 1")]


def test_command_line(images, tmp_path, capsys):
    from strataspan.__main__ import main

    assert main(["layout", str(images / "disk.img")]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["table"] == "mbr" and [p["fs"] for p in found["partitions"]] == ["vfat", "ext2"]
    assert main(["probe", str(images / "disk.qcow2")]) == 0 and '"qcow2"' in capsys.readouterr().out
    assert main(["copy", "--mode=restore", "--from", str(images / "none"), "--to", str(tmp_path / "x")]) == 1
    assert main(["copy", "--mode=restore", "--from", str(images / "disk.vmdk"), "--to", str(tmp_path / "x"), "--block-size", "5"]) == 1
    assert main(["copy", "--mode=restore", "--from", str(images / "disk.vmdk"), "--to", str(tmp_path / "x")]) == 0
    assert (tmp_path / "x").read_bytes() == (images / "disk.img").read_bytes()
