"""Smart images: a drive in one seekable zstd file, where free space costs next to nothing and a map of the used ranges comes first.

Version 2: a skippable frame with the map, zstd frames with either used data or zeros, and a seek table in a last skippable frame, so
any zstd decoder gives the whole drive. Version 1 was gzip members, their sizes in a `DG` extra field and the map in the first comment.
The map's first line is a parameter, for images whose writer signs with another.
"""

from __future__ import annotations

import base64
import struct
import zlib
from dataclasses import dataclass

import zstandard

from strataspan.formats.reader import Bad, Source, ensure, le16, le32

MAGIC = "strataspan smart image v2"
MAGIC_V1 = "strataspan smart image v1"
#: Frame magics of zstd and of its seekable format.
MAP_FRAME, TABLE_FRAME, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
MAP_MOST, FRAMES_MOST = 64 << 20, 1 << 24
DATA, ZEROS, LEAST_ZEROS, FRAME_MOST = 4 << 20, 64 << 20, 4096, 64 << 20


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, where the next begins) of a LEB128 number of at most 64 bits."""
    n = shift = 0
    while True:
        ensure(at < len(data) and shift < 64, "a number runs past the end")
        n |= (data[at] & 127) << shift
        at += 1
        shift += 7
        if data[at - 1] < 128:
            ensure(n < 1 << 64, "a number of more than 64 bits")
            return n, at


def to_text(size: int, extents: list[tuple[int, int]], magic: str = MAGIC) -> str:
    """The map of used ranges (start, end), sorted and apart."""
    unit = 4096 if all(s % 4096 == 0 and (e % 4096 == 0 or e == size) for s, e in extents) else 1
    raw, at = bytearray(), 0
    for s, e in extents:
        raw += put_varint((s - at) // unit) + put_varint(-(-(e - s) // unit))
        at = e
    text = base64.b64encode(raw).decode().rstrip("=")
    return f"{magic}\nsize={size} used={sum(e - s for s, e in extents)} extents={len(extents)} unit={unit}\nmap={text}\n"


def parse(text: bytes, magic: str = MAGIC) -> tuple[int, list[tuple[int, int]]] | None:
    """(size, ranges); None if the first line isn't the magic; Bad if the map is damaged or doesn't add up."""
    lines = text.split(b"\n")
    if lines[0] != magic.encode():
        return None
    try:
        facts = dict(w.split("=", 1) for w in lines[1].decode().split())
        size, used, count, unit = (int(facts[k]) for k in ("size", "used", "extents", "unit"))
        ensure(lines[2].startswith(b"map=") and unit > 0 and all(facts[k].isdigit() for k in ("size", "used", "extents", "unit")), "damaged map")
        body = lines[2][4:]
        raw = base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (ValueError, KeyError, IndexError) as e:
        raise Bad("the map of used space is damaged") from e
    out, at, pos = [], 0, 0
    while at < len(raw):
        gap, at = get_varint(raw, at)
        n, at = get_varint(raw, at)
        start, end = pos + gap * unit, pos + (gap + n) * unit
        if size < end < size + unit:
            end = size
        ensure(start < end <= size, "the map of used space is damaged")
        out.append((start, end))
        pos = end
    ensure(len(out) == count and sum(e - s for s, e in out) == used, "the map of used space is damaged")
    return size, out


def map_frame(size: int, extents: list[tuple[int, int]], magic: str = MAGIC) -> bytes:
    text = to_text(size, extents, magic).encode()
    return struct.pack("<II", MAP_FRAME, len(text)) + text


def read_map(s: Source, magic: str = MAGIC) -> tuple[int, list[tuple[int, int]], int] | None:
    """(size, ranges, bytes of the map's frame) at the start of a file; None if none is there."""
    h = s.upto(0, 8)
    if len(h) < 8 or le32(h, 0) != MAP_FRAME or le32(h, 4) > MAP_MOST:
        return None
    text = s.upto(8, le32(h, 4))
    found = parse(text, magic)
    ensure(found is None or len(text) == le32(h, 4), "the smart image is cut short")
    return (*found, 8 + len(text)) if found else None


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (bytes in the file, bytes unpacked), the map's among them with 0."""
    body = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", TABLE_FRAME, len(body) + 9) + body + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(s: Source) -> tuple[list[tuple[int, int]], int]:
    """(frames, where the table starts)."""
    ensure(s.size >= 17, "no seek table")
    n, kind, magic = struct.unpack("<IBI", s.read(s.size - 9, 9))
    ensure(magic == SEEKABLE, "no seek table")
    ensure(not kind & 0x7C, "a seek table of an unknown kind")
    width = 12 if kind & 0x80 else 8
    body = n * width + 9
    ensure(n <= FRAMES_MOST and 8 + body <= s.size, "a damaged seek table")
    start = s.size - 8 - body
    raw = s.read(start, 8 + body - 9)
    ensure(le32(raw, 0) == TABLE_FRAME and le32(raw, 4) == body, "a damaged seek table")
    return [(le32(raw, o), le32(raw, o + 4)) for o in range(8, len(raw), width)], start


def compress(data: bytes) -> bytes:
    """One frame of level 3 with its size and a checksum; hash tables a size below the level's own stay in a core's cache."""
    p = zstandard.ZstdCompressionParameters.from_level(3, hash_log=16, chain_log=15, write_checksum=True, write_content_size=True)
    return zstandard.ZstdCompressor(compression_params=p).compress(data)


def zeros_frame(n: int) -> bytes:
    c = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compressobj(size=n)
    out, left = [], n
    while left:
        k = min(left, 1 << 20)
        out.append(c.compress(bytes(k)))
        left -= k
    return b"".join(out) + c.flush()


def zero_pieces(n: int) -> list[int]:
    """Lengths that free space is cut to, so that few different frames occur."""
    out = [ZEROS] * (n // ZEROS)
    n %= ZEROS
    while n >= LEAST_ZEROS:
        out.append(1 << n.bit_length() - 1)
        n -= out[-1]
    return out + [n] * (n > 0)


def plan(size: int, extents: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """The frames of an image: (start, length, is zeros), all of the drive in order."""
    out, at = [], 0
    for s, e in [*extents, (size, size)]:
        for n in zero_pieces(s - at):
            out.append((at, n, True))
            at += n
        while at < e:
            n = min(DATA, e - at)
            out.append((at, n, False))
            at += n
    return out


@dataclass
class Frame:
    offset: int
    packed: int
    start: int
    length: int


def frames(s: Source, magic: str = MAGIC) -> tuple[int, list[tuple[int, int]], list[Frame]]:
    """(size, used ranges, data frames) of a version 2 image, if its map and seek table add up."""
    found = read_map(s, magic)
    ensure(found, "not a smart image")
    size, extents, head = found
    listed, stop = read_seek_table(s)
    ensure(listed and listed[0] == (head, 0), "the seek table doesn't begin with the map")
    out, offset, start = [], 0, 0
    for packed, length in listed:
        ensure(length <= FRAME_MOST, "a frame too large")
        if length:
            out.append(Frame(offset, packed, start, length))
        offset += packed
        start += length
    ensure(offset == stop and start == size, "the seek table doesn't add up")
    return size, extents, out


def unpack(data: bytes, length: int) -> bytes:
    out = zstandard.ZstdDecompressor().decompress(data, max_output_size=length)
    ensure(len(out) == length, "a frame of another size")
    return out


def wanted(frame: Frame, extents: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a frame that are in use: none if it is free and need not be read."""
    a, b = frame.start, frame.start + frame.length
    return [(max(s, a), min(e, b)) for s, e in extents if s < b and a < e]


def gzip_header(s: Source, at: int) -> tuple[int, tuple[int, int] | None, bytes | None]:
    """(length, sizes of the member in the file and unpacked, comment) of a gzip member header."""
    h = s.upto(at, 10)
    ensure(h[:3] == b"\x1f\x8b\x08" and len(h) == 10, "no member header where one should start")
    flags, n, sizes, comment = h[3], 10, None, None
    ensure(not flags & 0xE0, "reserved header flags")
    if flags & 4:
        extra = s.read(at + 12, le16(s.read(at + 10, 2), 0))
        n, o = 12 + len(extra), 0
        while o + 4 <= len(extra) and o + 4 + le16(extra, o + 2) <= len(extra):
            if extra[o : o + 2] == b"DG" and le16(extra, o + 2) == 8:
                sizes = (le32(extra, o + 4), le32(extra, o + 8))
            o += 4 + le16(extra, o + 2)
    for flag, most in ((8, 1 << 16), (16, MAP_MOST)):
        if flags & flag:
            text, o = b"", at + n
            while b"\0" not in text:
                ensure(len(text) < most and o < s.size, "unterminated name or comment")
                text += s.upto(o, 4096)
                o = at + n + len(text)
            text = text.split(b"\0")[0]
            n += len(text) + 1
            comment = text if flag == 16 else comment
    return n + 2 * bool(flags & 2), sizes, comment


def members(s: Source, magic: str = MAGIC_V1) -> tuple[int, list[tuple[int, int]], list[Frame]]:
    """(size, used ranges, members) of a version 1 image: members follow each other by the sizes in their headers."""
    n, sizes, comment = gzip_header(s, 0)
    found = parse(comment, magic) if comment else None
    ensure(found and sizes, "not a smart image of version 1")
    size, extents = found
    out, offset, start = [], sizes[0], 0
    while start < size:
        _, sizes, _ = gzip_header(s, offset)
        ensure(sizes and sizes[0] > 18 and 0 < sizes[1] <= FRAME_MOST and start + sizes[1] <= size, "a damaged member header")
        out.append(Frame(offset, sizes[0], start, sizes[1]))
        offset, start = offset + sizes[0], start + sizes[1]
    ensure(offset == s.size, "data behind the last member")
    return size, extents, out


def inflate(data: bytes, length: int) -> bytes:
    """One gzip member, its checksum checked."""
    try:
        out = zlib.decompress(data, 31)
    except zlib.error as e:
        raise Bad(f"a damaged member: {e}") from e
    ensure(len(out) == length, "a member of another size")
    return out
