"""Image, drive and stream operators on samples made from rules (the driver's tables hold no images), and byte functions on documents.

Samples are files in a folder that driver and executors share, so these queries run where that is a mounted path."""

from __future__ import annotations

import itertools
import json
import os
import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.formats import samples
from strataspan.functions import binary
from strataspan.operators import copying, extents
from strataspan.plans.interval_queries import table
from strataspan.plans.registry import query
from strataspan.sources import disk_sources, drives
from strataspan.streaming import worker


def _folder(spark: SparkSession) -> str:
    """A folder for samples: within spark.checkpoint.dir if it is a file path, else the machine's temporary one (local masters)."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
        return tempfile.mkdtemp(prefix="samples-", dir=shared)
    return tempfile.mkdtemp(prefix="samples-")


def _put(folder: str, images: dict[str, bytes]) -> str:
    for name, data in images.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    return f"{folder}/*"


def disks() -> dict[str, bytes]:
    """Raw drives with tables and file systems."""
    fat, ext = samples.fat(16, 9000, [5, 6, 7, 100, 8000]), samples.ext2()
    return {
        "gpt.img": samples.gpt([(2048, 22048), (30000, 40000)], 32 << 20, [fat, ext]),
        "mbr.img": samples.mbr([(0x0E, 2048, 20000), (0x82, 30000, 512), (0x83, 40000, 8192)], 32 << 20, [fat, samples.swap(), ext]),
        "floppy.img": samples.fat(12, 2000, [5, 6, 7, 100]),
        "disc.iso": samples.iso(),
        "card.img": samples.exfat(),
        "blank.img": bytes(4 << 20),
    }


def containers() -> dict[str, bytes]:
    d = samples.reference()
    return {"a.vhd": samples.vhd_dynamic(d), "b.vhd": samples.vhd_fixed(d), "c.qcow2": samples.qcow2(d), "d.qcow2": samples.qcow2(d, packed=True), "e.vmdk": samples.vmdk_sparse(d), "f.vmdk": samples.vmdk_sparse(d, True), "g.dmg": samples.dmg(d)}


#: What the builders of disks() were asked for, in SQL: partitions, and the ranges in each that a copy needs. FAT16 here has 105 sectors before
#: its clusters and 9,105 in all, ext2 200 blocks of 1 KiB behind the first, exFAT 42 clusters of 4 KiB behind 64 sectors; what lies behind a
#: file system is needed too, 64 KiB at the start of each partition, and 1 MiB at both ends of a drive.
LAYOUT_SQL = """
WITH parts(image, scheme, image_size, idx, start, size, fs, label, why) AS (VALUES
  ('gpt.img', 'gpt', 33554432, 1, 2048 * 512, 20001 * 512, 'vfat', 'SAMPLE', NULL), ('gpt.img', 'gpt', 33554432, 2, 30000 * 512, 10001 * 512, 'ext2', 'sample', NULL),
  ('mbr.img', 'mbr', 33554432, 1, 2048 * 512, 20000 * 512, 'vfat', 'SAMPLE', NULL), ('mbr.img', 'mbr', 33554432, 2, 30000 * 512, 512 * 512, 'swap', 'swapper', NULL),
  ('mbr.img', 'mbr', 33554432, 3, 40000 * 512, 8192 * 512, 'ext2', 'sample', NULL), ('floppy.img', 'none', 2027 * 512, 0, 0, 2027 * 512, 'vfat', 'SAMPLE', NULL),
  ('disc.iso', 'none', 200 * 2048, 0, 0, 200 * 2048, 'iso9660', 'SAMPLE_DISC', NULL), ('card.img', 'none', 64 * 512 + 600 * 4096, 0, 0, 64 * 512 + 600 * 4096, 'exfat', 'SAMPLE', NULL),
  ('blank.img', 'none', 4194304, 0, 0, 4194304, NULL, NULL, 'nothing recognised')),
fat16(a, b) AS (SELECT * FROM (VALUES (0, 105 * 512), (9105 * 512, NULL)) UNION ALL SELECT (103 + c) * 512, (104 + c) * 512 FROM (VALUES (5), (6), (7), (100), (8000)) t(c)),
need(image, s, e) AS (
  SELECT image, start + a, start + coalesce(b, size) FROM parts, fat16 WHERE fs = 'vfat' AND idx = 1
  UNION ALL SELECT image, start + a, start + coalesce(b, size) FROM parts, (VALUES (0, 201 * 1024), (4096 * 1024, NULL)) t(a, b) WHERE fs = 'ext2'
  UNION ALL SELECT image, start, start + 64 * 512 + 42 * 4096 FROM parts WHERE fs = 'exfat'
  UNION ALL SELECT image, start, start + size FROM parts WHERE fs IS NULL OR fs = 'iso9660'
  UNION ALL SELECT image, start, start + least(65536, size) FROM parts
  UNION ALL SELECT image, 0, least(1048576, image_size) FROM parts UNION ALL SELECT image, greatest(0, image_size - 1048576), image_size FROM parts),
wide AS (SELECT DISTINCT n.image, s - s % 4096 AS s, least(e + (4096 - e % 4096) % 4096, image_size) AS e FROM need n JOIN (SELECT DISTINCT image, image_size FROM parts) USING (image) WHERE s < e),
marked AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY image ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 65536 THEN 0 ELSE 1 END AS fresh FROM wide),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY image ORDER BY s, e) AS island FROM marked),
merged AS (SELECT image, min(s) AS s, max(e) AS e FROM numbered GROUP BY image, island),
used AS (SELECT p.image, p.idx, sum(greatest(0, least(e, start + size) - greatest(s, start))) AS used FROM parts p JOIN merged m ON m.image = p.image GROUP BY p.image, p.idx)
"""


@query("disk_layout", LAYOUT_SQL + """SELECT image, scheme AS "table", CAST(image_size AS BIGINT) AS image_size, CAST(idx AS INTEGER) AS "index", CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size,
  fs, label, CAST(used AS BIGINT) AS used, why IS NULL AS understood, why FROM parts JOIN used USING (image, idx)""")
def disk_layout(spark: SparkSession, sf: str) -> DataFrame:
    disk_sources.register(spark)
    df = spark.read.format("disk_layout").option("path", _put(_folder(spark), disks())).load()
    return df.withColumn("image", F.substring_index("image", "/", -1))


@query("disk_used", LAYOUT_SQL + """SELECT image, CAST(idx AS INTEGER) AS "index", CAST(used AS BIGINT) AS recorded, CAST(used AS BIGINT) AS used FROM used""")
def disk_used(spark: SparkSession, sf: str) -> DataFrame:
    """Used bytes of each partition by a range join of partitions and extents: the same numbers as the layout's own."""
    disk_sources.register(spark)
    path = _put(_folder(spark), disks())
    parts = spark.read.format("disk_layout").option("path", path).load()
    ranges = spark.read.format("disk_layout").option("path", path).option("what", "extents").load()
    windows = parts.where("index >= 0").select("image", "index", "start", (F.col("start") + F.col("size")).alias("end"), F.col("used").alias("recorded"))
    out = extents.overlap_sum(ranges, windows, ["image"], 1 << 24)
    return out.select(F.substring_index("image", "/", -1).alias("image"), "index", "recorded", F.col("used").cast("long").alias("used"))


def _header_rows() -> str:
    """The samples by the format that was built, the bytes of the file and of the drive in it (whole sectors, but for QCOW2)."""
    n, rows = len(samples.reference()), [(name, "raw", len(b), len(b)) for name, b in disks().items()]
    for name, b in containers().items():
        kind = name.split(".")[1]
        rows.append((name, kind, len(b), n if kind == "qcow2" else -(-n // 512) * 512))
    return ", ".join(f"('{name}', '{kind}', CAST({size} AS BIGINT), CAST({inner} AS BIGINT))" for name, kind, size, inner in rows)


@query("image_headers", f"SELECT *, CAST(NULL AS BIGINT) AS smart_size, CAST(NULL AS BIGINT) AS smart_used FROM (VALUES {_header_rows()}) t(image, format, size, uncompressed)")
def image_headers(spark: SparkSession, sf: str) -> DataFrame:
    disk_sources.register(spark)
    df = spark.read.format("image_headers").option("path", _put(_folder(spark), {**disks(), **containers()})).load()
    return df.withColumn("image", F.substring_index("image", "/", -1))


def _piece_rows() -> str:
    """The units of each virtual disk that hold anything, in order: runs of them are cut where the format keeps them apart, runs of zeros never."""
    d, rows = samples.reference(), []
    whole = d.ljust(-(-len(d) // 512) * 512, b"\0")
    kinds = [("a.vhd", "stored", 512, 1 << 16, whole), ("b.vhd", "stored", len(whole), len(whole), whole), ("c.qcow2", "stored", 1 << 16, len(d), d), ("d.qcow2", "packed", 1 << 16, 1 << 16, d)]
    kinds += [("e.vmdk", "stored", 1 << 16, len(whole), whole), ("f.vmdk", "packed", 1 << 16, 1 << 16, whole), ("g.dmg", "packed", 1 << 18, 1 << 18, whole)]
    for name, kind, unit, cut, data in kinds:
        units = [(at, data[at : at + unit]) for at in range(0, len(data), unit)]
        for _, run in itertools.groupby(units, lambda u: u[0] // cut if any(u[1]) else -1):
            pieces = list(run)
            rows.append((name, kind if any(pieces[0][1]) else "zeros", sum(len(b) for _, b in pieces)))
    return ", ".join(f"('{name}', '{kind}', {n})" for name, kind, n in rows)


@query("image_pieces", f"SELECT image, kind, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS bytes FROM (VALUES {_piece_rows()}) t(image, kind, n) GROUP BY image, kind")
def image_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each kind in each virtual disk."""
    disk_sources.register(spark)
    df = spark.read.format("image_pieces").option("path", _put(_folder(spark), containers())).load()
    return df.groupBy(F.substring_index("image", "/", -1).alias("image"), "kind").agg(F.count("*").alias("pieces"), F.sum("length").alias("bytes"))


def _chunk_rows() -> str:
    """The chunks of the sample drives, cut and summed without Spark, as rows of SQL."""
    rows = [(n, at, zlib.crc32(b[at : at + (1 << 20)]), b[at + 510 : at + 512] == b"\x55\xaa") for n, b in disks().items() for at in range(0, len(b), 1 << 20)]
    return ", ".join(f"('{n}', CAST({at} AS BIGINT), CAST({crc} AS BIGINT), {str(signed).lower()})" for n, at, crc, signed in rows)


@query("byte_chunks", f"SELECT * FROM (VALUES {_chunk_rows()}) t(image, pos, crc, signed)")
def byte_chunks(spark: SparkSession, sf: str) -> DataFrame:
    disk_sources.register(spark)
    df = spark.read.format("byte_chunks").option("path", _put(_folder(spark), disks())).option("chunk", 1 << 20).load()
    return df.select(F.substring_index("image", "/", -1).alias("image"), "pos", F.crc32("bytes").alias("crc"), binary.magic(F.col("bytes"), 510, b"\x55\xaa").alias("signed"))


@query("smart_roundtrip")
def smart_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A drive to a smart image and back: the frames, and how many chunks came back equal (those with junk in free space don't)."""
    disk_sources.register(spark)
    folder = _folder(spark)
    source = _put(folder, {"gpt.img": disks()["gpt.img"]}).replace("*", "gpt.img")
    copying.backup(spark, source, f"{folder}/gpt.zst", f"file://{folder}")
    size = copying.restore(spark, f"{folder}/gpt.zst", f"{folder}/back.img")
    chunk = lambda p: spark.read.format("byte_chunks").option("path", p).option("chunk", 1 << 20).load().select("pos", "bytes")
    both = chunk(source).withColumnRenamed("bytes", "a").join(chunk(f"{folder}/back.img").withColumnRenamed("bytes", "b"), "pos")
    ok = both.agg(F.count("*").alias("chunks"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("equal"))
    frames = spark.read.format("smart_frames").option("path", f"{folder}/gpt.zst").load().agg(F.count("*").alias("frames"), F.sum("used").alias("used"), F.sum((F.col("used") == 0).cast("long")).alias("free"))
    return ok.join(F.broadcast(frames)).withColumn("size", F.lit(size))


LSBLK = {"blockdevices": [
    {"name": "sda", "path": "/dev/sda", "size": 480103981056, "type": "disk", "tran": "sata", "rota": True, "rm": False, "ro": False, "model": "Quarry_Q500", "vendor": "ATA", "children": [{"name": "sda1", "path": "/dev/sda1", "mountpoints": ["/"], "fstype": "ext4", "label": "root"}]},
    {"name": "sdb", "path": "/dev/sdb", "size": "62109253632", "type": "disk", "tran": "usb", "rm": "1", "model": "Pebble  Mini", "vendor": "Harbour", "children": [{"name": "sdb1", "path": "/dev/sdb1", "mountpoint": "/mnt/pebble", "fstype": "vfat"}]},
    {"name": "zram1", "size": 4096, "type": "disk"},
]}
POWERSHELL = [{"Number": 1, "Name": "Pebble USB Disk", "Size": 15728640000, "Bus": "7", "Volumes": {"value": [{"Letter": "e", "Label": "FIELDWORK", "FileSystem": "FAT32"}], "Count": 1}}]


@query("drive_listing")
def drive_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("a", "linux", json.dumps(LSBLK)), ("b", "windows", "WARNING: x\r\n" + json.dumps(POWERSHELL))]
    return drives.drives_of(spark.createDataFrame(rows, "host string, os string, listing string"))


@query(
    "worker_status",
    "SELECT CAST(user_id AS VARCHAR) AS job, CAST(max(event_id) AS BIGINT) AS done, CAST(sum(CASE WHEN floor(value) >= 0 THEN floor(value) END) AS BIGINT) AS written FROM events GROUP BY user_id",
)
def worker_status(spark: SparkSession, sf: str) -> DataFrame:
    """Events as workers' lines, parsed, and summed up for each job."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job"), "event_id", F.concat(F.lit(" @progress "), F.col("event_id").cast("string"), F.lit(" "), F.floor("value").cast("string"), F.lit("\r")).alias("line"))
    p = worker.parse_status(e)
    return p.groupBy("job").agg(F.max("done").alias("done"), F.sum("written").alias("written"))


@query("dd_lines", "SELECT count(*) AS lines, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def dd_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Progress lines as dd writes them, for the sizes of documents."""
    line = F.concat(F.col("n_chars").cast("string"), F.lit(" bytes (7.3 kB, 7.1 KiB) copied, 0.25 s, 29 kB/s"))
    d = table(spark, sf, "documents").select(line.alias("line"))
    return d.select(worker.dd_progress(F.col("line")).alias("n")).agg(F.count("n").alias("lines"), F.sum("n").alias("bytes"))


@query("checksums")
def checksum_columns(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("text").cast("binary")
    d = table(spark, sf, "documents").select("doc_id", b.alias("b"))
    cols = {n: getattr(binary, n)(F.col("b")) for n in ("crc32", "crc32c", "crc16", "crc_itu", "fletcher64", "xxh32", "xxh64", "ones_sum", "xor16")}
    return d.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("zstd_roundtrip", "SELECT doc_id, true AS same FROM documents")
def zstd_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    packed = d.withColumn("z", binary.zstd_pack("b"))
    return packed.select("doc_id", (binary.decode_block(F.lit("zstd"), F.col("z"), F.octet_length("b")) == F.col("b")).alias("same"))


@query("map_roundtrip", "SELECT user_id, true AS same FROM (SELECT DISTINCT user_id FROM events)")
def map_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The hours in which each user has events, as a map's text and back."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    e = table(spark, sf, "events").select("user_id", (hour * 4096).alias("start")).distinct()
    merged = extents.merge_gap(e.withColumn("end", F.col("start") + 4096), ["user_id"])
    m = merged.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"), F.max("end").alias("size"))
    return m.select("user_id", (binary.map_ranges(binary.map_text("size", "ranges")) == F.col("ranges")).alias("same"))


@query(
    "bitmap_runs",
    "WITH b AS (SELECT doc_id, n_chars AS n FROM documents), i AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM b, range(0, 63) t(k) WHERE (n >> k) & 1 = 1) SELECT doc_id, CAST(min(k) AS BIGINT) AS first_bit, CAST(max(k) + 1 AS BIGINT) AS end_bit FROM i GROUP BY doc_id, r",
)
def bitmap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of set bits in a 64-bit number, lowest bit first."""
    raw = F.unhex(F.lpad(F.hex("n_chars"), 16, "0"))
    d = table(spark, sf, "documents").select("doc_id", raw.alias("b"), F.lit(64).alias("n"))
    d = d.withColumn("run", F.explode(binary.runs_of_bits(msb_first=True)("b", "n")))
    return d.select("doc_id", (64 - F.col("run.end")).alias("first_bit"), (64 - F.col("run.start")).alias("end_bit"))
