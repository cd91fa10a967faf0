"""Byte-level BPE encoding and decoding (operator 1).

A long text is cut into overlapping chunks. Each is pre-tokenised by itself, in parallel, from its own first character on, which may lie
within a pre-token: its first boundaries can be wrong, its later ones fall in with those of the scan before it. A chunk hands on the boundaries that
it found in the overlap with the chunk before and in that with the chunk after. Where two chunks meet, the two scans' boundaries in the overlap are
compared: from the first place on that both have, both go on alike, as a match depends on what follows it only; there the left chunk ends
and the right one begins. A boundary near the end of a chunk isn't trusted, as a match may go on behind the end. The pre-tokens between two such places are
encoded by themselves. Where an overlap has no such place (a run of letters longer than it, say), the stretch up to the next one that has is scanned and encoded as one. Decoding
concatenates the bytes of the ids.

Short texts are one chunk and never leave their task; only the chunks of long texts are dealt out.

Defined results: a null or empty text has no ids; rows that repeat give repeated results; strings of special
tokens are ordinary text; very long texts are encoded whole; an empty table gives no rows; nothing is read from columns other than those named.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import table

CHUNK, OVERLAP = 32_768, 512
#: A match that ends this near the end of a chunk may go on behind it ('re and the like look ahead two characters).
EDGE = 4


@lru_cache(4)
def encoder(ranks_file: str, pattern: str):
    """The tiktoken encoder and the bytes of every id."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    parts = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        parts[rank] = piece
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), parts


@lru_cache(4)
def _scanner(pattern: str):
    import regex

    return regex.compile(pattern)


def starts(text: str, pattern: str) -> list[int]:
    """Where the matches of the pattern begin."""
    return [m.start() for m in _scanner(pattern).finditer(text)]


@lru_cache(4096)
def _white(c: str) -> bool:
    return _scanner(r"\s").match(c) is not None


def scan(text: str, last: bool, pattern: str) -> list[int]:
    """The boundaries that a chunk's own scan finds, but for those that text behind the chunk may move, and those after white space: a match of
    white space looks at what follows it, so a piece that ended there would be pre-tokenised otherwise by itself."""
    found = [s for s in starts(text, pattern) if not s or not _white(text[s - 1])]
    if last:
        return [*found, len(text)]
    run = len(text) - _scanner(r"\s*").match(text[::-1]).end()  # white space that goes on behind the end may be split otherwise
    return [s for s in found if s <= min(len(text) - EDGE, run)]


def sync_point(left: list[int], right: list[int]) -> int | None:
    """The first place that two scans of an overlap both have as a boundary, behind its first character; or None."""
    both = set(left).intersection(right)
    both.discard(0)
    return min(both, default=None)


def stitch(chunks: list[tuple[str, int | None, bytes | None]], size: int, pattern: str, encode) -> bytes:
    """The ids of a text from its chunks in order: (text with the overlap behind it, where the piece begins, ids of the piece up to where
    the next one begins). begin is None where the scan shares no boundary with that of the chunk before, ids where the piece has no end. Behind
    such a place a scan counts again from the first beginning that is a boundary of the text scanned from there on."""
    out, i = [], 0
    while i < len(chunks):
        _, begin, ids = chunks[i]
        if ids is not None:
            out.append(ids)
            i += 1
            continue
        text, j = "", i
        while j < len(chunks):
            text += chunks[j][0][begin if j == i else 0 : size]
            j += 1
            if j < len(chunks) and chunks[j][1] is not None:
                ahead = text + chunks[j][0]
                at = len(text) + chunks[j][1]
                if at in starts(ahead, pattern):
                    text = ahead[:at]
                    break
        else:
            text += chunks[-1][0][size:]
        out.append(np.array(encode(text), dtype="<u4").tobytes())
        i = j
    return b"".join(out)


_CHUNK = "doc_id long, text_key string, n int, i int, kind int, chunk string, places array<int>"
_PIECE = "doc_id long, text_key string, i int, copies int, chunk string, begin int, ids binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _cut(size: int, overlap: int):
    """The chunks of each text: characters i * size to (i + 1) * size + overlap, the last all from i * size on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = hashlib.md5(text.encode()).hexdigest(), max(1, -(-(len(text) - overlap) // size))
                for i in range(n):
                    yield _rows(_CHUNK, [(doc, key, n, i, 0, text[i * size : (i + 1) * size + overlap if i < n - 1 else len(text)], None)])

    return run


def _scanned(size: int, pattern: str):
    """Chunks, and what their scans find in the overlaps, for the chunks after (kind 1) and before (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, n, i, _, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = scan(text, i == n - 1, pattern)
                out = [(doc, key, n, i, 0, text, None)]
                if i < n - 1:
                    out.append((doc, key, n, i + 1, 1, None, [s - size for s in found if s >= size]))
                if i:
                    out.append((doc, key, n, i - 1, 2, None, found))
                yield _rows(_CHUNK, out)

    return run


ENCODED = "doc_id long, ids binary"


class Ids:
    """What becomes of the ids of a text: here they are kept. A subclass can make other columns of them in the same task."""

    schema = "ids binary"

    def __init__(self, ranks_file: str, pattern: str):
        self.ranks_file, self.pattern = ranks_file, pattern

    def columns(self, ids: list[bytes]) -> list[pa.Array]:
        return [pa.array(ids, pa.binary())]

    @property
    def names(self) -> list[str]:
        return ["doc_id", *(c.split(" ")[0] for c in self.schema.split(", "))]


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, then: type[Ids] = Ids) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one row for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = then(ranks_file, pattern)
    schema = f"doc_id long, {made.schema}"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(ranks_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() if t else b"" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *made.columns(ids)], names=made.names)

    def piece(rows: pa.Table) -> pa.Table:
        """A chunk's piece, between the places where its scan falls in with those of the chunks before and after."""
        enc, _ = encoder(ranks_file, pattern)
        kind, text = rows.column("kind").to_pylist(), rows.column("chunk").to_pylist()
        n, i, text = rows.column("n")[0].as_py(), rows.column("i")[0].as_py(), text[kind.index(0)]
        told = {k: p for k, p in zip(kind, rows.column("places").to_pylist(), strict=True) if k}
        own = scan(text, i == n - 1, pattern)
        begin = sync_point(told[1], own) if i else 0
        end = sync_point([s - chunk for s in own if s >= chunk], told[2]) if i < n - 1 else len(text) - chunk
        ids = None if begin is None or end is None else np.array(enc.encode_ordinary(text[begin : chunk + end]), dtype="<u4").tobytes()
        key = rows.column("doc_id")[0].as_py(), rows.column("text_key")[0].as_py()
        return pa.Table.from_batches([_rows(_PIECE, [(*key, i, kind.count(0), text, begin, ids)])])

    def whole(rows: pa.Table) -> pa.Table:
        """A document's pieces in order, for each of its copies."""
        enc, _ = encoder(ranks_file, pattern)
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("i", "chunk", "begin", "ids")), strict=True))
        ids, copies = stitch([p[1:] for p in parts], chunk, pattern, enc.encode_ordinary), rows.column("copies")[0].as_py()
        return pa.table([pa.array([rows.column("doc_id")[0].as_py()] * copies, pa.int64()), *made.columns([ids] * copies)], names=made.names)

    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    near = docs.where(~is_long).mapInArrow(short, schema)
    far = docs.where(is_long).mapInArrow(_cut(chunk, overlap), _CHUNK).repartition("doc_id", "i").mapInArrow(_scanned(chunk, pattern), _CHUNK)
    far = far.groupBy("doc_id", "text_key", "i").applyInArrow(piece, _PIECE)
    return near.unionByName(far.groupBy("doc_id", "text_key").applyInArrow(whole, schema))


def decode_ids(ids: bytes, ranks_file: str, pattern: str) -> bytes:
    """The bytes that the ids stand for."""
    parts = encoder(ranks_file, pattern)[1]
    return b"".join(map(parts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """The rows of encode_documents with `decoded`, the bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode_ids(x, ranks_file, pattern) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, ENCODED + ", decoded binary")


class Digests(Ids):
    """Count and hash of the ids, and the hash of the bytes that they decode to."""

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def columns(self, ids: list[bytes]) -> list[pa.Array]:
        sha = hashlib.sha256
        decoded = [sha(decode_ids(x, self.ranks_file, self.pattern)).hexdigest() for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return encode_documents(docs, ranks_file, pattern, then=Digests)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return digests(table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
