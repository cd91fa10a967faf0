"""Functions on bytes: fields, checksums, codecs, maps. Big-endian fields are column expressions; the rest works on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from strataspan.formats import checksums, codecs, smart
from strataspan.formats.bits import bit_runs
from strataspan.formats.reader import Bad, le16, le32, le64


def be(data: Column, at: int, width: int) -> Column:
    """A big-endian number of up to 7 bytes; 0 where data ends before it."""
    raw = F.substring(data, at + 1, width)
    return F.when(F.octet_length(raw) == width, F.conv(F.hex(raw), 16, 10).cast("bigint")).otherwise(0)


def magic(data: Column, at: int, expected: bytes) -> Column:
    """Whether these bytes stand there."""
    return F.hex(F.substring(data, at + 1, len(expected))) == expected.hex().upper()


def _per_value(kind, f):
    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(bytes(x)) for x in data], dtype=object)

    return run


def le(width: int, at: int):
    """A column function for a little-endian number at an offset; 0 where data ends before it, 2^63-1 where it doesn't fit."""
    read = {2: le16, 4: le32, 8: le64}[width]
    return _per_value(LongType(), lambda b: min(read(b, at), (1 << 63) - 1))


_signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
crc32c = _per_value(LongType(), checksums.crc32c)
crc16 = _per_value(LongType(), lambda b: checksums.crc16(0, b))
crc_itu = _per_value(LongType(), checksums.crc_itu)
fletcher64 = _per_value(LongType(), lambda b: _signed(checksums.fletcher64(b)))
xxh32 = _per_value(LongType(), checksums.xxh32)
xxh64 = _per_value(LongType(), lambda b: _signed(checksums.xxh64(b)))
ones_sum = _per_value(LongType(), checksums.ones_sum)
xor16 = _per_value(LongType(), checksums.xor16)
rotate_add = _per_value(LongType(), checksums.rotate_add)


def crc32(data: Column) -> Column:
    """IEEE, built in."""
    return F.crc32(data)


@F.pandas_udf(BinaryType())
def decode_block(codec: pd.Series, data: pd.Series, most: pd.Series) -> pd.Series:
    """zlib, deflate, zstd, bzip2, xz, adc or raw data, unpacked to at most so many bytes; null if it is damaged or unknown."""

    def one(c, b, n):
        try:
            return codecs.decode(c, bytes(b), int(n))
        except Bad:
            return None

    return pd.Series([None if b is None else one(c, b, n) for c, b, n in zip(codec, data, most, strict=True)], dtype=object)


zstd_pack = _per_value(BinaryType(), smart.compress)
zstd_unpack = _per_value(BinaryType(), lambda b: codecs.decode("zstd", b, 1 << 40))

RUN = StructType([StructField("start", LongType()), StructField("end", LongType())])


@F.pandas_udf(StringType())
def map_text(size: pd.Series, ranges: pd.Series) -> pd.Series:
    """A smart image's map of sorted ranges [(start, end)]."""
    out = []
    for n, r in zip(size, ranges, strict=True):
        out.append(smart.to_text(int(n), [(int(x["start"]), int(x["end"])) for x in r]))
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(RUN))
def map_ranges(text: pd.Series) -> pd.Series:
    """The ranges of a map; null if it is damaged or none."""

    def one(t):
        try:
            found = smart.parse(t.encode())
        except Bad:
            return None
        return None if found is None else [{"start": a, "end": b} for a, b in found[1]]

    return pd.Series([None if t is None else one(t) for t in text], dtype=object)


def runs_of_bits(msb_first: bool = False, invert: bool = False):
    """A column function (data, bits): runs of set (or clear) bits as [(start, end)]."""

    @F.pandas_udf(ArrayType(RUN))
    def run(data: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else [{"start": s, "end": s + n} for s, n in bit_runs(bytes(d), int(b), 0, msb_first, invert)] for d, b in zip(data, bits, strict=True)], dtype=object)

    return run
