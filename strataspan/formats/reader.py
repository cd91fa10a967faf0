"""Random access to bytes: files, bytes in memory, windows, and overlays of patches. No Spark here."""

from __future__ import annotations

import os
import struct

MOST = 64 << 20  # bytes of one read
BLOCK = 64 << 10


class Short(Exception):
    """A read beyond the end."""


class Bad(Exception):
    """Metadata that doesn't hold: the text says what."""


def ensure(ok: object, why: str) -> None:
    if not ok:
        raise Bad(why)


class Source:
    """Bytes with a size; reads are exact or raise Short. One block is kept for neighbouring small reads."""

    size: int

    def __init__(self, size: int):
        self.size = size
        self._at, self._block = -1, b""

    def _read(self, at: int, n: int) -> bytes:
        raise NotImplementedError

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size or n > MOST:
            raise Short(f"{n} bytes at {at} of {self.size}")
        if n > BLOCK // 2:
            return self._read(at, n)
        if not (self._at <= at and at + n <= self._at + len(self._block)):
            start = at - at % BLOCK
            want = min(2 * BLOCK, self.size - start)
            self._at, self._block = start, self._read(start, want)
        return self._block[at - self._at : at - self._at + n]

    def upto(self, at: int, n: int) -> bytes:
        """As many of n bytes as there are."""
        return self.read(at, max(0, min(n, self.size - at))) if at < self.size else b""

    def window(self, start: int, size: int) -> Source:
        return Window(self, start, size)


class Memory(Source):
    def __init__(self, data: bytes):
        super().__init__(len(data))
        self.data = data

    def _read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class File(Source):
    """A file or block device, opened when first read."""

    def __init__(self, path: str):
        self.path, self._file = path, None
        with open(path, "rb") as f:
            super().__init__(f.seek(0, os.SEEK_END))

    def _read(self, at: int, n: int) -> bytes:
        if self._file is None:
            self._file = open(self.path, "rb")
        self._file.seek(at)
        data = self._file.read(n)
        if len(data) != n:
            raise Short(f"{n} bytes at {at} of {self.path}")
        return data


class Window(Source):
    """A part of a source, addresses counted from its start."""

    def __init__(self, base: Source, start: int, size: int):
        super().__init__(max(0, min(size, base.size - start)))
        self.base, self.start = base, start

    def _read(self, at: int, n: int) -> bytes:
        return self.base.read(self.start + at, n)


class Patched(Source):
    """A source with patches (offset, length, data or None for zeros) on top, later ones winning; zeros beyond its end."""

    def __init__(self, base: Source, patches: list[tuple[int, int, bytes | None]], size: int | None = None):
        super().__init__(max(base.size, size or 0, *(o + n for o, n, _ in patches), 0))
        self.base, self.patches = base, patches

    def _read(self, at: int, n: int) -> bytes:
        out = bytearray(self.base.upto(at, n).ljust(n, b"\0"))
        for o, length, data in self.patches:
            a, b = max(o, at), min(o + length, at + n)
            if a < b:
                out[a - at : b - at] = data[a - o : b - o] if data is not None else bytes(b - a)
        return bytes(out)


class Chunks(Source):
    """A source put together from rows (position, bytes) of a chunk table."""

    def __init__(self, chunks: list[tuple[int, bytes]], size: int | None = None):
        self.chunks = sorted(chunks)
        super().__init__(size if size is not None else max((p + len(b) for p, b in self.chunks), default=0))

    def _read(self, at: int, n: int) -> bytes:
        out = bytearray(n)
        for p, b in self.chunks:
            lo, hi = max(p, at), min(p + len(b), at + n)
            if lo < hi:
                out[lo - at : hi - at] = b[lo - p : hi - p]
        return bytes(out)


def field(kind: str, data: bytes, at: int) -> int:
    """A number (a struct code such as '<I'), 0 where data ends before it."""
    n = struct.calcsize(kind)
    return struct.unpack_from(kind, data, at)[0] if 0 <= at and at + n <= len(data) else 0


def le16(data: bytes, at: int) -> int:
    return field("<H", data, at)


def le32(data: bytes, at: int) -> int:
    return field("<I", data, at)


def le64(data: bytes, at: int) -> int:
    return field("<Q", data, at)


def be16(data: bytes, at: int) -> int:
    return field(">H", data, at)


def be32(data: bytes, at: int) -> int:
    return field(">I", data, at)


def be64(data: bytes, at: int) -> int:
    return field(">Q", data, at)


def round_up(n: int, to: int) -> int:
    return -(-n // to) * to


def is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def utf16_label(raw: bytes) -> str | None:
    """UTF-16LE up to the first NUL."""
    return tidy_label(raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0])


def byte_label(raw: bytes) -> str | None:
    """Latin-1 up to the first NUL."""
    return tidy_label(raw.split(b"\0")[0].decode("latin-1"))


def tidy_label(text: str) -> str | None:
    return text.rstrip(" \0").lstrip() or None
