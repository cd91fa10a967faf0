"""Maps of virtual disks: what each stretch of the disk is made of, in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from strataspan.formats import codecs
from strataspan.formats.reader import MOST, Bad, Source, ensure


@dataclass(frozen=True)
class Piece:
    """kind zeros, stored (bytes at offset) or packed (packed_len bytes at offset, coded, giving size bytes of which length count;
    short_ok: fewer are no error, zeros follow)."""

    length: int
    kind: str
    offset: int = 0
    packed_len: int = 0
    codec: str | None = None
    size: int = 0
    short_ok: bool = False


def zeros(n: int) -> Piece:
    return Piece(n, "zeros")


def stored(n: int, offset: int) -> Piece:
    return Piece(n, "stored", offset)


@dataclass
class Image:
    """A virtual disk: format, size, the source with its patches, and its pieces."""

    format: str
    size: int
    source: Source
    pieces: Iterator[Piece]

    def placed(self) -> Iterator[tuple[int, Piece]]:
        """(position, piece), neighbours of one kind united, cut at the disk's end; what pieces don't cover is zeros."""
        at, held, start = 0, None, 0
        for p in self.pieces:
            if p.length <= 0 or at >= self.size:
                continue
            if p.kind != "packed" and at + p.length > self.size:
                p = Piece(self.size - at, p.kind, p.offset)
            joins = held and held.kind == p.kind and (p.kind == "zeros" or p.kind == "stored" and held.offset + held.length == p.offset)
            if joins:
                held = Piece(held.length + p.length, p.kind, held.offset)
            else:
                if held:
                    yield start, held
                held, start = p, at
            at += p.length
        if held:
            yield start, held
        if at < self.size:
            yield at, zeros(self.size - at)


def piece_bytes(s: Source, p: Piece, most: int = MOST) -> bytes:
    """What a piece of at most `most` bytes holds."""
    ensure(p.length <= most, "a piece too large to be read at once")
    if p.kind == "zeros":
        return bytes(p.length)
    if p.kind == "stored":
        return s.upto(p.offset, p.length).ljust(p.length, b"\0")
    out = codecs.decode(p.codec or "raw", s.upto(p.offset, p.packed_len), p.size)
    if len(out) < p.size and not p.short_ok:
        raise Bad(f"a block at {p.offset} gives {len(out)} bytes of {p.size}")
    return out.ljust(p.length, b"\0")[: p.length]


def contents(image: Image, step: int = 4 << 20) -> Iterator[bytes]:
    """All bytes of the disk, in order and in pieces of at most `step` or a block."""
    for at, p in image.placed():
        if p.kind == "packed":
            yield piece_bytes(image.source, p)[: image.size - at]
            continue
        for o in range(0, p.length, step):
            n = min(step, p.length - o)
            yield piece_bytes(image.source, Piece(n, p.kind, p.offset + o))
