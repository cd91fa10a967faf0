"""The first file with content in a 7z archive. Encrypted archives and coders that the standard library lacks are refused."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from strataspan.formats.reader import Bad, Short, Source, ensure, le32, le64

#: Ids of properties in a header, and of coders.
END, HEADER, MAIN_STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, UNPACK_SIZE, NUM_STREAMS, EMPTY_STREAM, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 0x17
COPY, LZMA, LZMA2, BZIP2, DEFLATE, X86, DELTA, AES = b"\0", b"\x03\x01\x01", b"\x21", b"\x04\x02\x02", b"\x04\x01\x08", b"\x03\x03\x01\x03", b"\x03", b"\x06\xf1\x07\x01"
MEMORY = 1_610_612_736
STEP = 1 << 20


class _Bytes:
    """Reads a header field by field."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        ensure(0 <= n <= len(self.data) - self.at, "a 7z header cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading ones of the first byte say how many bytes follow; its other bits are the highest."""
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & mask - 1) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] >> 7 - i % 8 & 1) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes]]  # (method, properties), the last one applied when packing last
    sizes: list[int] = field(default_factory=list)
    first_pack: int = 0
    streams: list[int] = field(default_factory=list)


@dataclass
class Streams:
    start: int = 0
    packed: list[int] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)


def _folder(b: _Bytes) -> Folder:
    coders, inputs = [], 0
    n = b.number()
    ensure(1 <= n <= 4, "a 7z folder of too many coders")
    for _ in range(n):
        flags = b.byte()
        method = b.take(flags & 15)
        if flags & 16:
            ensure(b.number() == 1 == b.number(), "a 7z coder with several streams")
        coders.append((method, b.take(b.number()) if flags & 32 else b""))
        inputs += 1
    order = {}
    for _ in range(n - 1):
        into, out = b.number(), b.number()
        order[into] = out
    first = next((i for i in range(n) if i not in order), None)
    ensure(first is not None, "a 7z folder in a ring")
    chain = [first]  # from the packed data on: the coder whose input nothing feeds, then those that it feeds
    while len(chain) < n:
        following = next((i for i, o in order.items() if o == chain[-1]), None)
        ensure(following is not None and following not in chain, "a 7z folder in a ring")
        chain.append(following)
    return Folder([coders[i] for i in chain], first_pack=0, sizes=[], streams=chain)


def _streams(b: _Bytes) -> Streams:
    out = Streams()
    kind = b.byte()
    if kind == PACK:
        out.start, n = b.number(), b.number()
        ensure(n <= 1 << 16, "too many 7z streams")
        while (kind := b.byte()) != END:
            if kind == SIZE:
                out.packed = [b.number() for _ in range(n)]
            elif kind == CRC:
                b.take(4 * sum(b.defined(n)))
            else:
                raise Bad("an unknown 7z property")
        kind = b.byte()
    if kind == UNPACK:
        ensure(b.byte() == FOLDER, "a damaged 7z header")
        n = b.number()
        ensure(n <= 1 << 16 and b.byte() == 0, "7z folders elsewhere")
        out.folders = [_folder(b) for _ in range(n)]
        ensure(b.byte() == UNPACK_SIZE, "a damaged 7z header")
        for f in out.folders:
            sizes = [b.number() for _ in f.coders]
            f.sizes = [sizes[i] for i in f.streams]  # in the order of unpacking
            f.streams = [f.sizes[-1]]
        while (kind := b.byte()) != END:
            ensure(kind == CRC, "an unknown 7z property")
            b.take(4 * sum(b.defined(n)))
        for k, f in enumerate(out.folders):
            f.first_pack = k
        kind = b.byte()
    if kind == SUBSTREAMS:
        counts = [1] * len(out.folders)
        kind = b.byte()
        if kind == NUM_STREAMS:
            counts = [b.number() for _ in out.folders]
            kind = b.byte()
        for f, n in zip(out.folders, counts, strict=True):
            ensure(n <= 1 << 20, "too many 7z streams")
            sizes = [b.number() for _ in range(n - 1)] if kind == SIZE else []
            rest = f.sizes[-1] - sum(sizes)
            ensure(rest >= 0 and (kind == SIZE or n <= 1), "a damaged 7z header")
            f.streams = [*sizes, rest] if n else []
        while kind != END:
            if kind == CRC:
                n = sum(len(f.streams) for f in out.folders)
                b.take(4 * sum(b.defined(n)))
            kind = b.byte()
    return out


def _filters(coders: list[tuple[bytes, bytes]]) -> list[dict]:
    """The library's filters for a chain of LZMA, delta and x86 coders, outermost first."""
    out = []
    for method, p in reversed(coders):
        if method == LZMA:
            ensure(len(p) == 5 and p[0] < 225 and le32(p, 1) <= MEMORY, "7z data of unknown properties")
            out.append({"id": lzma.FILTER_LZMA1, "dict_size": max(4096, le32(p, 1)), "lc": p[0] % 9, "lp": p[0] // 9 % 5, "pb": p[0] // 45})
        elif method == LZMA2:
            ensure(len(p) == 1 and p[0] <= 40, "7z data of unknown properties")
            size = 0xFFFFFFFF if p[0] == 40 else (2 | p[0] & 1) << p[0] // 2 + 11
            ensure(size <= MEMORY, "7z data needs too much memory")
            out.append({"id": lzma.FILTER_LZMA2, "dict_size": size})
        elif method == X86:
            out.append({"id": lzma.FILTER_X86})
        elif method == DELTA:
            out.append({"id": lzma.FILTER_DELTA, "dist": (p[0] if p else 0) + 1})
        else:
            raise Bad("7z data in AES: the archive is encrypted" if method == AES else f"7z data of an unknown kind ({method.hex()})")
    return out


def _unpack(s: Source, at: int, packed: int, folder: Folder, most: int) -> Iterator[bytes]:
    """Up to `most` bytes of a folder."""
    methods = [m for m, _ in folder.coders]
    if methods == [COPY]:
        decoder = None
    elif methods == [BZIP2]:
        decoder = bz2.BZ2Decompressor()
    elif methods == [DEFLATE]:
        decoder = zlib.decompressobj(-15)
    else:
        coders = [c for c in folder.coders if c[0] != COPY]
        decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_filters(coders))
    end = at + packed
    while most > 0 and (at < end or decoder is not None):
        raw = s.upto(at, min(STEP, end - at)) if at < end else b""
        at += len(raw)
        try:
            piece = raw if decoder is None else decoder.decompress(raw)
        except (OSError, lzma.LZMAError, zlib.error, EOFError) as e:
            raise Bad(f"damaged 7z data: {e}") from e
        piece = piece[:most]
        most -= len(piece)
        if piece:
            yield piece
        elif at >= end:
            break
    ensure(most <= 0, "7z data that ends too early")


def _header(s: Source) -> tuple[_Bytes, int]:
    h = s.upto(0, 32)
    ensure(len(h) == 32 and h[:6] == b"7z\xbc\xaf\x27\x1c" and zlib.crc32(h[12:32]) == le32(h, 8), "a damaged 7z start header")
    offset, size = le64(h, 12), le64(h, 20)
    ensure(size <= 64 << 20 and 32 + offset + size <= s.size, "a 7z archive cut short")
    raw = s.read(32 + offset, size)
    ensure(zlib.crc32(raw) == le32(h, 28), "a damaged 7z header")
    for _ in range(4):
        b = _Bytes(raw)
        kind = b.byte() if raw else END
        if kind == HEADER:
            return b, size
        ensure(kind == ENCODED, "an empty 7z archive")
        inner = _streams(b)
        ensure(len(inner.folders) == 1 and inner.packed and inner.folders[0].sizes[-1] <= 64 << 20, "a damaged 7z header")
        raw = b"".join(_unpack(s, 32 + inner.start, inner.packed[0], inner.folders[0], inner.folders[0].sizes[-1]))
    raise Bad("a 7z header packed again and again")


def first_file(s: Source) -> tuple[int, Iterator[bytes]]:
    """(size, content) of the first file with content: the first stream of the first folder that has one."""
    try:
        b, _ = _header(s)
        kind = b.byte()
        ensure(kind == MAIN_STREAMS, "the archive holds no files")
        found = _streams(b)
    except Short as e:
        raise Bad("a 7z archive cut short") from e
    ensure(len(found.packed) >= len(found.folders), "a damaged 7z header")
    at = 32 + found.start
    for f, packed in zip(found.folders, found.packed, strict=False):
        before = 0
        for n in f.streams:
            if n:
                return n, _unpack(s, at, packed, f, before + n)
            before += n
        at += packed
    raise Bad("the archive holds no files")
