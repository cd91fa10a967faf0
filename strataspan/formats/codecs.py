"""Block and stream codecs. A block gives at most `most` bytes; input that ends early is not an error here: what is missing shows in the length."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import xxhash
import zstandard

from strataspan.formats import checksums
from strataspan.formats.reader import Bad, Source, ensure, le32, le64


def unadc(data: bytes, most: int) -> bytes:
    """Apple Data Compression: literals, and copies of two widths."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        c = data[at]
        if c & 0x80:
            n = (c & 0x7F) + 1
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
            continue
        if c & 0x40:
            n, back, step = (c & 0x3F) + 4, int.from_bytes(data[at + 1 : at + 3].ljust(2, b"\0"), "big"), 3
        else:
            n, back, step = (c >> 2 & 0x0F) + 3, (c & 3) << 8 | (data[at + 1] if at + 1 < len(data) else 0), 2
        if at + step > len(data):
            break
        ensure(back < len(out), "a copy from before the start")
        for _ in range(n):
            out.append(out[-back - 1])
        at += step
    return bytes(out[:most])


def unlz4_block(data: bytes, before: bytes, most: int) -> bytes:
    """One LZ4 block; copies may reach into what came before it."""
    out, at, start = bytearray(before), 0, len(before)
    while at < len(data):
        token = data[at]
        at += 1
        n = token >> 4
        if n == 15:
            while True:
                ensure(at < len(data), "a truncated block")
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        ensure(at + n <= len(data), "a truncated block")
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        ensure(at + 2 <= len(data), "a truncated block")
        back = int.from_bytes(data[at : at + 2], "little")
        at += 2
        n = token & 15
        if n == 15:
            while True:
                ensure(at < len(data), "a truncated block")
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        n += 4
        ensure(0 < back <= len(out), "a copy from before the start")
        if back >= n:
            out += out[len(out) - back : len(out) - back + n]
        else:
            piece = bytes(out[-back:])
            out += (piece * (n // back + 1))[:n]
        ensure(len(out) - start <= most, "a block larger than it may be")
    return bytes(out[start:])


def decode(codec: str, data: bytes, most: int) -> bytes:
    """One block."""
    try:
        if codec in ("zlib", "deflate"):
            return zlib.decompressobj(15 if codec == "zlib" else -15).decompress(data, most)
        if codec == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)[:most]
        if codec == "bzip2":
            return bz2.BZ2Decompressor().decompress(data, most)
        if codec == "xz":
            return lzma.LZMADecompressor(lzma.FORMAT_AUTO).decompress(data, most)
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, ValueError) as e:
        raise Bad(f"damaged {codec} data: {e}") from e
    if codec == "adc":
        return unadc(data, most)
    if codec == "raw":
        return data[:most]
    raise Bad(f"{codec} data, which isn't supported")


STEP = 1 << 20


def _pieces(s: Source, at: int = 0) -> Iterator[bytes]:
    while at < s.size:
        piece = s.upto(at, STEP)
        at += len(piece)
        yield piece


def _members(s: Source, start, done, padding: bytes = b"") -> Iterator[bytes]:
    """A stream of members back to back; each has a decoder of its own. Padding may follow."""
    decoder, fresh, rest = None, True, b""
    for piece in _pieces(s):
        rest += piece
        while rest:
            if decoder is None:
                if padding and not fresh:
                    rest = rest.lstrip(padding)
                    if not rest:
                        break
                decoder, fresh = start(), False
            out = decoder.decompress(rest)
            if out:
                yield out
            if done(decoder):
                rest, decoder = decoder.unused_data, None
            else:
                rest = b""
    if decoder is not None:
        raise Bad("the data ends too early")


def stream(kind: str, s: Source) -> Iterator[bytes]:
    """The unpacked bytes of a compressed file, member after member."""
    try:
        if kind == "gzip":
            yield from _members(s, lambda: zlib.decompressobj(31), lambda d: d.eof, b"\0")
        elif kind == "bzip2":
            yield from _members(s, bz2.BZ2Decompressor, lambda d: d.eof, b"\0")
        elif kind == "xz":
            yield from _members(s, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), lambda d: d.eof, b"\0")
        elif kind == "lzma":
            yield from _members(s, lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=1_800_000_000), lambda d: d.eof)
        elif kind == "zstd":
            d = zstandard.ZstdDecompressor(max_window_size=1 << 31)
            yield from _members(s, d.decompressobj, lambda x: x.eof)
        elif kind == "lz4":
            yield from _lz4(s)
        elif kind == "zip":
            yield from _zip(s)
        elif kind == "raw":
            yield from _pieces(s)
        else:
            raise Bad(f"{kind} files aren't unpacked")
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError) as e:
        raise Bad(f"damaged {kind} data: {e}") from e


class _File:
    """A source as a file object."""

    def __init__(self, s: Source):
        self.s, self.at = s, 0

    def read(self, n: int = -1) -> bytes:
        out = self.s.upto(self.at, self.s.size - self.at if n is None or n < 0 else n)
        self.at += len(out)
        return out

    def seek(self, to: int, how: int = 0) -> int:
        self.at = to + (0, self.at, self.s.size)[how]
        return self.at

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return True


def _zip(s: Source) -> Iterator[bytes]:
    """The first regular file of an archive that holds something."""
    import zipfile

    try:
        z = zipfile.ZipFile(_File(s))
    except zipfile.BadZipFile as e:
        raise Bad(f"damaged zip archive: {e}") from e
    entry = next((i for i in z.infolist() if not i.is_dir() and i.file_size and (i.external_attr >> 16) & 0o170000 in (0, 0o100000)), None)
    ensure(entry, "the zip archive holds no files")
    try:
        with z.open(entry) as f:
            while piece := f.read(STEP):
                yield piece
    except (NotImplementedError, RuntimeError, zipfile.BadZipFile) as e:
        raise Bad(str(e)) from e


def zip_size(s: Source) -> int | None:
    import zipfile

    try:
        entries = zipfile.ZipFile(_File(s)).infolist()
    except zipfile.BadZipFile:
        return None
    return next((i.file_size for i in entries if not i.is_dir() and i.file_size), None)


#: Magics of LZ4 frames.
LZ4, LZ4_LEGACY = 0x184D2204, 0x184C2102


def skippable(magic: int) -> bool:
    return magic & 0xFFFFFFF0 == 0x184D2A50


def _lz4(s: Source) -> Iterator[bytes]:
    at = 0
    while at < s.size:
        magic = le32(s.upto(at, 4), 0)
        at += 4
        if skippable(magic):
            at += 4 + le32(s.upto(at, 4), 0)
        elif magic == LZ4_LEGACY:
            while at + 4 <= s.size:
                n = le32(s.read(at, 4), 0)
                if n in (LZ4, LZ4_LEGACY) or skippable(n):
                    break
                at += 4
                yield unlz4_block(s.read(at, n), b"", 8 << 20)
                at += n
        else:
            ensure(magic == LZ4, "no LZ4 frame where one should start")
            flags, block = s.read(at, 2)
            ensure(flags >> 6 == 1 and not flags & 2 and not block & 0x8F and block >> 4 >= 4, "an LZ4 frame of an unknown kind")
            ensure(not flags & 1, "LZ4 data with a dictionary")
            head = 2 + 8 * bool(flags & 8)
            ensure(checksums.xxh32(s.read(at, head)) >> 8 & 0xFF == s.read(at + head, 1)[0], "a damaged LZ4 header")
            size = le64(s.read(at + 2, 8), 0) if flags & 8 else None
            at += head + 1
            most, before, total = 1 << 2 * (block >> 4) + 8, b"", 0
            whole = xxhash.xxh32(seed=0)
            while True:
                n = le32(s.read(at, 4), 0)
                at += 4
                if n == 0:
                    break
                raw = s.read(at, n & 0x7FFFFFFF)
                at += len(raw)
                if flags & 16:
                    ensure(checksums.xxh32(raw) == le32(s.read(at, 4), 0), "an LZ4 block whose checksum is wrong")
                    at += 4
                out = raw if n >> 31 else unlz4_block(raw, b"" if flags & 32 else before, most)
                ensure(len(out) <= most, "a block larger than it may be")
                before = (before + out)[-65536:]
                whole.update(out)
                total += len(out)
                yield out
            if flags & 4:
                ensure(whole.intdigest() == le32(s.read(at, 4), 0), "LZ4 content whose checksum is wrong")
                at += 4
            ensure(size is None or size == total, "LZ4 content of another size")


def xz_size(s: Source) -> int | None:
    """The unpacked size from the indexes of all streams, read from the end."""
    end, total = s.size, 0
    while end > 0:
        if end < 12:
            return None
        foot = s.read(end - 12, 12)
        if foot[8:] == bytes(4):
            end -= 4
            continue
        n = (le32(foot, 4) + 1) * 4
        if foot[10:] != b"YZ" or n > min(1 << 30, end - 12):
            return None
        index, at, packed = s.read(end - 12 - n, n), 1, 0

        def vli() -> int:
            nonlocal at
            v = shift = 0
            while True:
                ensure(at < len(index) and shift < 63, "a damaged index")
                v |= (index[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if index[at - 1] < 128:
                    return v

        try:
            for _ in range(vli()):
                packed += -(-vli() // 4) * 4
                total += vli()
        except Bad:
            return None
        end -= 12 + n + packed + 12
        if end < 0 or s.read(end, 6) != b"\xfd7zXZ\0":
            return None
    return total


def zstd_size(s: Source) -> int | None:
    """From the seek table, else from the first frame's header."""
    from strataspan.formats import smart

    try:
        return sum(n for _, n in smart.read_seek_table(s)[0])
    except Bad:
        pass
    at = 0
    while at + 8 <= s.size and skippable(le32(s.read(at, 4), 0)):
        at += 8 + le32(s.read(at + 4, 4), 0)
    head = s.upto(at, 18)
    if le32(head, 0) != 0xFD2FB528 or len(head) < 6:
        return None
    try:
        n = zstandard.frame_content_size(head)
    except zstandard.ZstdError:
        return None
    return n if n >= 0 else None
