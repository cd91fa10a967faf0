"""Corpus-wide line dedup (operator 4).

Hashes of lines are dealt out by range over (hash, document, position) and sorted in each partition, so equal
lines stand together with their first document in front, and a line that is very common is spread over several
partitions instead of filling one. Each partition streams its rows once and keeps a single run in hand. Only the
run at the head of a partition may go on from the one before; its rows wait for a table with one or two rows for
each partition. What comes out is not text: each document that loses lines gets a compressed bitmap of those it keeps.

Defined results: a null or empty text is one empty line; a null doc_id takes no part and keeps every line; rows
that share a doc_id are one document when lines are counted, each text keeping its own bitmap; lines repeated in
the first document that holds them all stay there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import broadcast_if_small, discard, materialise, shuffle_partitions, table

WHITE = " \t\n\x0b\x0c\r"
KEYS = "h binary, doc_id long, pos int, n_lines int, text_crc long"
RUNS = "kind int, h binary, doc_id long, pos int, n_lines int, text_crc long"
BITMAPS = "doc_id long, text_crc long, n_lines long, n_dropped long, keep binary"
DROP, WAITING, EDGE = 0, 1, 2


def _arrow(schema: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(KEYS)
        blake = hashlib.blake2b
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                h, ids, pos, total, crcs = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    lines = text.split("\n")
                    n, crc = len(lines), zlib.crc32(text.encode())
                    for i, line in enumerate(lines):
                        key = line.strip(WHITE)
                        if len(key) >= min_chars:
                            h.append(blake(key.encode().lower(), digest_size=16).digest())  # bytes.lower() changes A-Z only
                            ids.append(doc)
                            pos.append(i)
                            total.append(n)
                            crcs.append(crc)
                yield pa.record_batch([pa.array(h, pa.binary()), pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(total, pa.int32()), pa.array(crcs, pa.int64())], schema=schema)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, doc_id, pos). Emits the lines to drop, the rows of the head run, and the runs at both edges."""
    schema = _arrow(RUNS)
    head = None  # hash of the first run and its first document
    last, first_doc = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.dtype([("a", "<u8"), ("b", "<u8")]))
        doc = batch.column(1).to_numpy(zero_copy_only=False)
        new = np.empty(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        here = batch.column(0)[0].as_py()
        new[0] = here != last
        if last is None:
            head = (here, int(doc[0]))
        run = np.cumsum(new)
        firsts = np.concatenate([[first_doc if first_doc is not None else 0], doc[new]])[run]
        last, first_doc = batch.column(0)[batch.num_rows - 1].as_py(), int(firsts[-1])
        in_head = (run == 0) & (here == head[0]) if not new[0] else (run == 1) & (here == head[0])
        drop = np.flatnonzero(~in_head & (doc > firsts))
        wait = np.flatnonzero(in_head)
        for kind, rows in ((DROP, drop), (WAITING, wait)):
            if len(rows):
                taken = batch.take(pa.array(rows))
                hashes = taken.column(0) if kind == WAITING else pa.nulls(len(rows), pa.binary())
                yield pa.record_batch([pa.array(np.full(len(rows), kind, np.int32)), hashes, *taken.columns[1:]], schema=schema)
    if head is not None:
        edges = {head[0]: head[1]} | ({last: first_doc} if last != head[0] else {})
        none = pa.nulls(len(edges), pa.int32())
        yield pa.record_batch([pa.array([EDGE] * len(edges), pa.int32()), pa.array(list(edges), pa.binary()), pa.array(list(edges.values()), pa.int64()), none, none, pa.nulls(len(edges), pa.int64())], schema=schema)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(BITMAPS)
    for batch in batches:
        keep, dropped = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, dtype=np.uint8)
            bits[gone] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(int(n - bits.sum()))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], schema=schema)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_crc, n_lines, n_dropped, keep) of each document that loses lines; all others keep every line.

    keep: zlib of bits, the first line in the highest bit. A line goes if its key (stripped, A-Z lower-cased, at
    least min_chars code points) is also in a document with a smaller doc_id."""
    spark = docs.sparkSession
    keys = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = materialise(keys.mapInArrow(_line_keys(min_chars), KEYS), "line-keys")
    order = ["h", "doc_id", "pos"]
    ordered = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    runs = materialise(ordered.mapInArrow(_first_occurrences, RUNS), "line-runs")
    edges = runs.where(F.col("kind") == EDGE).groupBy("h").agg(F.min("doc_id").alias("first_doc"))  # two rows a partition at most
    cols = ["doc_id", "text_crc", "pos", "n_lines"]
    waited = runs.where(F.col("kind") == WAITING).join(F.broadcast(edges), "h").where("doc_id > first_doc").select(*cols)
    drops = runs.where(F.col("kind") == DROP).select(*cols).unionByName(waited)
    by_doc = drops.groupBy("doc_id", "text_crc").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("gone"))
    out = materialise(by_doc.mapInArrow(_bitmaps, BITMAPS), "line-bitmaps")
    discard(keys, runs)
    return out


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their bitmap in `__keep_bitmap`, null where all lines stay. Text is shuffled only if the bitmaps
    are too large to broadcast."""
    b = bitmaps.select(F.col("doc_id").alias("__bitmap_doc"), F.col("text_crc").alias("__bitmap_crc"), F.col("keep").alias("__keep_bitmap"))
    b = broadcast_if_small(b, F.length("__keep_bitmap") + 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(b, (docs.doc_id == b["__bitmap_doc"]) & (crc == b["__bitmap_crc"]), "left").drop("__bitmap_doc", "__bitmap_crc")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and how many there were."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return [x for x, b in zip(lines, bits, strict=True) if b], len(lines)


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The documents, all columns, with `text` cut down to the lines that stay."""
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_chars))

    @F.pandas_udf("string")
    def render(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(kept_lines(t, k)[0]) for t, k in zip(text, keep, strict=True)])

    text = F.when(F.col("__keep_bitmap").isNull(), F.col("text")).otherwise(render("text", "__keep_bitmap"))
    return marked.withColumn("text", text).drop("__keep_bitmap")


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(DIGEST)
    for batch in batches:
        rows = []
        for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, n = kept_lines(text, keep)
            rows.append((n, n - len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3))], schema=schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "text", "__keep_bitmap").mapInArrow(_digest, DIGEST)


OP4_SQL = r"""
WITH l AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i)),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
