"""The first regular file with content in a tar archive, with GNU and pax sparse maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from strataspan.formats import checksums
from strataspan.formats.reader import Bad, Source, ensure, round_up

META_MOST = 16 << 20


@dataclass
class Member:
    """name, logical size, and the parts (offset in the file, offset in the archive, length) that aren't holes."""

    name: str
    size: int
    parts: list[tuple[int, int, int]]


def number(raw: bytes) -> int | None:
    """Octal text, or base 256 if the top bit is set; None if it is blank or neither."""
    if raw[:1] and raw[0] & 0x80:
        n = int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:], "big")
        return None if raw[0] & 0x40 or n >= 1 << 63 else n
    text = raw.split(b"\0")[0].strip(b" ")
    try:
        return int(text, 8) if text and all(48 <= c <= 55 for c in text) else None
    except ValueError:
        return None


def is_header(b: bytes) -> bool:
    return len(b) >= 512 and b[257:262] == b"ustar" and number(b[148:156]) in checksums.tar_sums(b)


def pax(raw: bytes) -> list[tuple[str, str]]:
    """Records `length key=value` and a newline, the length counting all of it."""
    out, at = [], 0
    while at < len(raw) and raw[at] != 0:
        space = raw.find(b" ", at, at + 20)
        ensure(space > 0 and raw[at:space].isdigit(), "a damaged pax header")
        n = int(raw[at:space])
        record = raw[space + 1 : at + n]
        ensure(at + n <= len(raw) and record[-1:] == b"\n" and b"=" in record, "a damaged pax header")
        key, value = record[:-1].split(b"=", 1)
        out.append((key.decode("utf-8", "replace"), value.decode("utf-8", "replace")))
        at += n
    return out


def first_file(s: Source) -> Member:
    """Folders, links and empty files are passed over."""
    at, facts, sparse_list, long_name = 0, {}, [], None
    while True:
        h = s.upto(at, 512)
        ensure(len(h) == 512 and any(h), "the archive holds no files")
        ensure(is_header(h), "a damaged tar header")
        kind, size = h[156:157], number(h[124:136])
        ensure(size is not None, "a damaged tar header")
        if kind in b"xg" and kind:
            ensure(size <= META_MOST, "a pax header too large")
            if kind == b"x":
                records = pax(s.read(at + 512, size))
                facts = dict(records)
                sparse_list = [(k, v) for k, v in records if k in ("GNU.sparse.offset", "GNU.sparse.numbytes")]
            at += 512 + round_up(size, 512)
            continue
        if kind in (b"L", b"K"):
            if kind == b"L":
                long_name = s.read(at + 512, min(size, META_MOST)).split(b"\0")[0].decode("utf-8", "replace")
            at += 512 + round_up(size, 512)
            continue
        size = int(facts.get("size", size))
        name = facts.get("GNU.sparse.name") or facts.get("path") or long_name or h[:100].split(b"\0")[0].decode("utf-8", "replace")
        data = at + 512
        if kind in (b"0", b"\0", b"7", b"S") and not name.endswith("/"):
            member = _member(s, h, kind, name, data, size, facts, sparse_list)
            if member.size:
                return member
        extended = kind == b"S" and h[482] == 1
        while extended:
            extended, data = s.read(data + 504, 1) == b"\1", data + 512
        at, facts, sparse_list, long_name = data + round_up(size, 512), {}, [], None


def _member(s: Source, h: bytes, kind: bytes, name: str, data: int, size: int, facts: dict, listed: list[tuple[str, str]]) -> Member:
    holes: list[tuple[int, int]] = []
    if kind == b"S":  # GNU: four pairs here, then 21 in each extension block
        real = number(h[483:495])
        ensure(real is not None, "a damaged sparse header")
        block, at, more = h, 386, h[482] == 1
        pairs = [block[o : o + 24] for o in range(386, 482, 24)]
        while more:
            block = s.read(data, 512)
            data += 512
            pairs += [block[o : o + 24] for o in range(0, 504, 24)]
            more = block[504] == 1
        for p in pairs:
            o, n = number(p[:12]), number(p[12:])
            if o is None or n is None:
                break
            holes.append((o, n))
        return _sparse(name, real, holes, data, size)
    if facts.get("GNU.sparse.major") == "1":
        lines, at = [], data
        text = b""
        count = None
        while count is None or len(lines) < 1 + 2 * count:
            ensure(at - data < META_MOST and at < data + size, "a damaged sparse map")
            text += s.read(at, 512)
            at += 512
            lines = text.split(b"\n")[:-1]
            count = int(lines[0]) if lines and count is None else count
        numbers = list(map(int, lines[1 : 1 + 2 * count]))
        return _sparse(name, int(facts["GNU.sparse.realsize"]), list(zip(numbers[::2], numbers[1::2], strict=True)), at, size - (at - data))
    if "GNU.sparse.map" in facts:
        numbers = list(map(int, facts["GNU.sparse.map"].split(","))) if facts["GNU.sparse.map"] else []
        return _sparse(name, int(facts["GNU.sparse.size"]), list(zip(numbers[::2], numbers[1::2], strict=True)), data, size)
    if "GNU.sparse.size" in facts:
        numbers = [int(v) for _, v in listed]
        return _sparse(name, int(facts["GNU.sparse.size"]), list(zip(numbers[::2], numbers[1::2], strict=True)), data, size)
    return Member(name, size, [(0, data, size)] if size else [])


def _sparse(name: str, size: int, parts: list[tuple[int, int]], at: int, stored: int) -> Member:
    out, last = [], 0
    for o, n in parts:
        ensure(o >= last and o + n <= size, "a sparse map out of order")
        if n:
            out.append((o, at, n))
        at, last, stored = at + n, o + n, stored - n
    ensure(stored >= 0, "a sparse map larger than its data")
    return Member(name, size, out)


def contents(s: Source, m: Member, step: int = 1 << 20) -> Iterator[bytes]:
    """The file's bytes, holes as zeros."""
    at = 0
    for o, where, n in [*m.parts, (m.size, 0, 0)]:
        while at < o:
            k = min(step, o - at)
            yield bytes(k)
            at += k
        for p in range(0, n, step):
            k = min(step, n - p)
            piece = s.upto(where + p, k)
            if len(piece) < k:
                raise Bad("the archive ends too early")
            yield piece
        at += n
