"""Python data sources over drives and images. One task reads one image's metadata; chunk scans split large files into ranges.

    spark.dataSource.register(DiskLayout) ... spark.read.format("disk_layout").option("path", "/images/*.img").load()

`register(spark)` registers all of them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strataspan.formats import detect, layout, smart
from strataspan.formats.reader import Bad, File, Short

MOST = (1 << 63) - 1


def _files(options: dict) -> list[str]:
    """Files of the comma-separated patterns in option `path`."""
    found = sorted({f for p in options.get("path", "").split(",") if p for f in glob.glob(p.strip())})
    if not found:
        raise FileNotFoundError(f"no image matches {options.get('path')!r}")
    return found


class _OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _PerFile(DataSourceReader):
    """One partition for each image."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(p) for p in _files(self.options)]


def _long(n: int | None) -> int | None:
    return None if n is None else min(n, MOST)


class _LayoutReader(_PerFile):
    def read(self, partition: _OneFile) -> Iterator[tuple]:
        found = layout.analyze(File(partition.path), self.options.get("mode", "copy"))
        if self.options.get("what", "partitions") == "extents":
            for s, e in found.extents:
                yield partition.path, _long(s), _long(e)
            return
        for p in found.partitions or [layout.Partition(-1, 0, found.size, None, None, found.used, False, found.whole)]:
            yield partition.path, found.table, _long(found.size), p.index, _long(p.start), _long(p.size), p.fs, p.label, _long(p.used), p.understood, p.why or found.whole


class DiskLayout(DataSource):
    """Partitions of drives or raw images (option what=partitions) or the ranges a copy needs (what=extents). mode: copy or estimate."""

    @classmethod
    def name(cls) -> str:
        return "disk_layout"

    def schema(self) -> str:
        if self.options.get("what", "partitions") == "extents":
            return "image string, start long, end long"
        return "image string, table string, image_size long, index int, start long, size long, fs string, label string, used long, understood boolean, why string"

    def reader(self, schema) -> DataSourceReader:
        return _LayoutReader(self.options)


class _HeaderReader(_PerFile):
    def read(self, partition: _OneFile) -> Iterator[tuple]:
        i = detect.probe(File(partition.path), self.options.get("magic", smart.MAGIC))
        yield partition.path, i.format, _long(i.size), _long(i.uncompressed), _long(i.smart_size), _long(i.smart_used)


class ImageHeaders(DataSource):
    """Format and sizes of image files, from headers alone."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "image string, format string, size long, uncompressed long, smart_size long, smart_used long"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options)


class _PieceReader(_PerFile):
    def read(self, partition: _OneFile) -> Iterator[tuple]:
        image = detect.open_image(File(partition.path))
        for at, p in image.placed():
            yield partition.path, _long(at), _long(p.length), p.kind, _long(p.offset), _long(p.packed_len), p.codec, _long(p.size), p.short_ok


class ImagePieces(DataSource):
    """The map of virtual disks: what each stretch is made of."""

    @classmethod
    def name(cls) -> str:
        return "image_pieces"

    def schema(self) -> str:
        return "image string, pos long, length long, kind string, offset long, packed_len long, codec string, size long, short_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _PieceReader(self.options)


class _FrameReader(_PerFile):
    def read(self, partition: _OneFile) -> Iterator[tuple]:
        _, extents, frames = smart.frames(File(partition.path), self.options.get("magic", smart.MAGIC))
        for k, f in enumerate(frames):
            used = sum(e - s for s, e in smart.wanted(f, extents))
            yield partition.path, k, _long(f.offset), f.packed, _long(f.start), f.length, used


class SmartFrames(DataSource):
    """The frames of smart images with the used bytes in each; a frame with none need not be read."""

    @classmethod
    def name(cls) -> str:
        return "smart_frames"

    def schema(self) -> str:
        return "image string, ord int, offset long, packed int, start long, length int, used long"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", MOST))
        self.chunk, self.split = int(options.get("chunk", 1 << 20)), int(options.get("split", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.options):
            first, last = self.low - self.low % self.chunk, min(os.path.getsize(path), self.high)
            out += [_Range(path, at, min(at + self.split, last)) for at in range(first, last, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        s = File(partition.path)
        for at in range(partition.start, partition.end, self.chunk):
            yield partition.path, at, s.upto(at, min(self.chunk, partition.end - at))


class ByteChunks(DataSource):
    """The bytes of files in chunks (option chunk, 1 MiB), a task for each `split` bytes. Options from and to bound the positions that
    are planned and read. (Filter push-down is left out on purpose: in this Spark release what one query pushes down stays with
    the source, and another query over the same DataFrame would miss rows.)"""

    @classmethod
    def name(cls) -> str:
        return "byte_chunks"

    def schema(self) -> str:
        return "image string, pos long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


class _Wrote(WriterCommitMessage):
    def __init__(self, end: int):
        self.end = end


class _RangeWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], options.get("size")
        if not os.path.exists(self.path):
            open(self.path, "ab").close()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        end = 0
        fd = os.open(self.path, os.O_WRONLY)
        try:
            for r in rows:
                data, at = bytes(r["bytes"]), r["pos"]
                while data:
                    n = os.pwrite(fd, data, at)
                    data, at = data[n:], at + n
                end = max(end, at)
            os.fsync(fd)
        finally:
            os.close(fd)
        return _Wrote(end)

    def commit(self, messages: list) -> None:
        end = int(self.size) if self.size else max([os.path.getsize(self.path), *(m.end for m in messages if m)])
        with open(self.path, "r+b") as f:
            f.truncate(end)
            os.fsync(f.fileno())

    def abort(self, messages: list) -> None:
        """Ranges are written in place, so what was written stays; a retried task writes the same bytes again."""


class RawRanges(DataSource):
    """A sink that puts rows (pos, bytes) into a file in place, leaving all else as it is, and then sets its size (option size)."""

    @classmethod
    def name(cls) -> str:
        return "raw_ranges"

    def schema(self) -> str:
        return "pos long, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RangeWriter(self.options)


ALL = [DiskLayout, ImageHeaders, ImagePieces, SmartFrames, ByteChunks, RawRanges]


def register(spark: SparkSession) -> None:
    for source in ALL:
        spark.dataSource.register(source)


__all__ = ["ALL", "Bad", "ByteChunks", "DiskLayout", "ImageHeaders", "ImagePieces", "RawRanges", "Short", "SmartFrames", "register"]
