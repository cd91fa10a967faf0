"""Copies as jobs: backup to a smart image, restore of any image, in-place copy of used ranges, zeros.

Work on bytes is spread over tasks by ranges of at most a few MiB; only the order of a smart image's frames needs one writer, which
streams finished frames from the shared folder and holds one at a time.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.formats import detect, layout, smart
from strataspan.formats.pieces import Piece, piece_bytes
from strataspan.formats.reader import Bad, File
from strataspan.sources import disk_sources

STEP = 4 << 20


def check_fits(needs: int, room: int | None) -> None:
    if room is not None and needs > room:
        raise Bad(f"the source ({needs} bytes) doesn't fit on the target ({room} bytes)")


def _write(rows: DataFrame, target: str, size: int | None) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(disk_sources.RawRanges)
    writer = rows.write.format("raw_ranges").mode("append").option("path", target)
    (writer.option("size", size) if size is not None else writer).save()


def _ranges(spark: SparkSession, parts: list[tuple[int, int]], step: int = STEP) -> DataFrame:
    """(pos, length) of ranges cut into steps; the list has at most 65,536 entries."""
    df = spark.createDataFrame(parts or [(0, 0)], "start long, end long").where("start < end")
    cut = df.select("end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(step).cast("long"))).alias("pos"))
    return cut.select("pos", F.least(F.lit(step), F.col("end") - F.col("pos")).alias("length")).repartition(spark.sparkContext.defaultParallelism)


def copy_used(spark: SparkSession, source: str, target: str, extents: list[tuple[int, int]] | None = None) -> int:
    """The used ranges of a drive or raw image to the same places in another file, whose other bytes stay. The bytes copied."""
    size = os.path.getsize(source)
    used = extents if extents is not None else layout.analyze(File(source)).extents
    check_fits(max((e for _, e in used), default=0), os.path.getsize(target) if os.path.exists(target) else None)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = File(source)
        for b in batches:
            for pos, n in zip(b["pos"], b["length"], strict=True):
                yield pd.DataFrame({"pos": [pos], "bytes": [s.read(int(pos), int(n))]})

    _write(_ranges(spark, used).mapInPandas(read, "pos long, bytes binary"), target, None if os.path.exists(target) else size)
    return sum(e - s for s, e in used)


def write_zeros(spark: SparkSession, target: str, size: int) -> None:
    """`size` zeros from the start of a file."""
    rows = _ranges(spark, [(0, size)])

    def zeros(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pos, n in zip(b["pos"], b["length"], strict=True):
                yield pd.DataFrame({"pos": [pos], "bytes": [bytes(int(n))]})

    _write(rows.mapInPandas(zeros, "pos long, bytes binary"), target, None)


def backup(spark: SparkSession, source: str, target: str, shared: str, extents: list[tuple[int, int]] | None = None, magic: str = smart.MAGIC) -> dict:
    """A drive or raw image as a smart image. shared: a folder that all executors see, for frames on their way."""
    size = os.path.getsize(source)
    used = extents if extents is not None else layout.analyze(File(source)).extents
    plan = [(k, s, n) for k, (s, n, free) in enumerate(smart.plan(size, used)) if not free]
    frames = spark.createDataFrame(plan or [(-1, 0, 0)], "ord long, start long, length long").where("ord >= 0").repartition(max(1, min(len(plan), 4 * spark.sparkContext.defaultParallelism)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = File(source)
        for b in batches:
            for k, at, n in zip(b["ord"], b["start"], b["length"], strict=True):
                yield pd.DataFrame({"ord": [k], "frame": [smart.compress(s.read(int(at), int(n)))]})

    folder = f"{shared.rstrip('/')}/frames-{uuid.uuid4().hex}"
    frames.mapInPandas(pack, "ord long, frame binary").write.parquet(folder)
    ready = spark.read.parquet(folder).orderBy("ord").toLocalIterator(prefetchPartitions=False)
    free: dict[int, bytes] = {}
    part = target + ".part"
    listed = []
    with open(part, "wb") as out:
        head = smart.map_frame(size, used, magic)
        out.write(head)
        listed.append((len(head), 0))
        for _, n, zero in smart.plan(size, used):
            frame = (free.get(n) or free.setdefault(n, smart.zeros_frame(n))) if zero else bytes(next(ready)["frame"])
            out.write(frame)
            listed.append((len(frame), n))
        out.write(smart.seek_table(listed))
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, target)
    if folder.removeprefix("file://").startswith("/"):
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    return {"size": size, "used": sum(e - s for s, e in used), "frames": len(listed), "written": os.path.getsize(target)}


def restore(spark: SparkSession, image: str, target: str, magic: str = smart.MAGIC) -> int:
    """An image of any format to a raw file from its start: of a smart image only what was in use is written, and free frames aren't
    read. The size of the disk."""
    s = File(image)
    kind = detect.kind_of(s)
    room = os.path.getsize(target) if os.path.exists(target) else None
    old = kind == "gzip" and detect.probe(s).smart_size is not None
    if old or kind == "zstd" and smart.read_map(s, magic):
        size, extents, frames = smart.members(s) if old else smart.frames(s, magic)
        check_fits(max((e for _, e in extents), default=0), room)
        jobs = [(f.offset, f.packed, f.start, f.length) for f in frames if smart.wanted(f, extents)]
        df = spark.createDataFrame(jobs or [(0, 0, 0, 0)], "offset long, packed long, start long, length long").where("length > 0").repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)))

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = File(image)
            for b in batches:
                for row in b.itertuples():
                    f = smart.Frame(int(row.offset), int(row.packed), int(row.start), int(row.length))
                    data = (smart.inflate if old else smart.unpack)(s.read(f.offset, f.packed), f.length)
                    for a, e in smart.wanted(f, extents):
                        yield pd.DataFrame({"pos": [a], "bytes": [data[a - f.start : e - f.start]]})

        _write(df.mapInPandas(unpack, "pos long, bytes binary"), target, size if room is None else None)
        return size
    if kind in detect.CONTAINERS:
        size = detect.open_image(s, kind).size
        check_fits(size, room)
        spark.dataSource.register(disk_sources.ImagePieces)
        pieces = spark.read.format("image_pieces").option("path", glob.escape(image)).load()
        cut = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(STEP).cast("long"))
        packed = pieces.where("kind = 'packed'").select("pos", F.lit(0).cast("long").alias("skip"), "length", "kind", "offset", "packed_len", "codec", "size", "short_ok")
        plain = pieces.where("kind <> 'packed'").withColumn("skip", F.explode(cut)).select(F.col("pos") + F.col("skip"), "skip", F.least(F.lit(STEP), F.col("length") - F.col("skip")).alias("length"), "kind", F.col("offset") + F.col("skip"), "packed_len", "codec", "size", "short_ok")

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = detect.open_image(File(image), kind).source
            for b in batches:
                for r in b.itertuples():
                    p = Piece(int(r.length), r.kind, int(r.offset), int(r.packed_len), r.codec, int(r.size), bool(r.short_ok))
                    yield pd.DataFrame({"pos": [r.pos], "bytes": [piece_bytes(s, p)[: size - int(r.pos)]]})

        rows = packed.unionByName(plain.toDF(*packed.columns)).repartition(spark.sparkContext.defaultParallelism)
        _write(rows.mapInPandas(decode, "pos long, bytes binary"), target, size if room is None else None)
        return size
    at = 0  # a compressed stream has one order: it is unpacked by one reader
    with open(target, "r+b" if room is not None else "wb") as out:
        for piece in detect.raw_bytes(s):
            check_fits(at + len(piece), room)
            out.write(piece)
            at += len(piece)
        os.fsync(out.fileno())
    return at
