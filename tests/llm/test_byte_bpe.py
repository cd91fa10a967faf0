import random

import numpy as np
import public_tokenizers as vocab
import pytest

from strataspan.llm import byte_bpe

RANKS, PATTERN = vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN


def ids_of(text):
    return np.array(byte_bpe.encoder(RANKS, PATTERN)[0].encode_ordinary(text or ""), dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    parts = ["a", "b", " ", "\n", "'s", "'r", "e", "1", ".", "é", "　", "中", "  \n\n", "\x1c", "\x85", "🎉"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 900)))) for i in range(250)]
    return rows + [(None, "x y"), (1000, None), (1001, ""), (1002, "a" * 3000), (1002, "a" * 3000), (1003, " " * 2000 + "b"), (1004, "\n" * 500 + "x"), (1006, "1234567890" * 60 + " x" * 200 + "12345678" * 50 + "é1" * 90), (1005, "<|endoftext|> hi"), (1005, "other text of the same id")]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (50, 7), (1 << 15, 512)])
def test_chunks_give_the_same_ids(spark, rows, chunk, overlap):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as i", "3 as kind", "4 as n")
    out = byte_bpe.encode_documents(df, RANKS, PATTERN, chunk, overlap)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, bytes(r.ids)) for r in out.collect()), key=key) == sorted(((d, ids_of(t)) for d, t in rows), key=key)


def test_decoding_gives_the_bytes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r.decoded) for r in out.collect()) == sorted((t or "").encode() for _, t in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(df, RANKS, PATTERN).count() == 0


def test_sync_point():
    left, right = "xx one two three four", "e two three four and more"
    shift = len("xx on")
    a = [s - shift for s in byte_bpe.scan(left, False, PATTERN) if s >= shift]
    b = byte_bpe.scan(right, False, PATTERN)
    assert byte_bpe.sync_point(a, b) == 1 and [s for s in a if s] == [s for s in b if 0 < s <= a[-1]]
    assert byte_bpe.sync_point([0], byte_bpe.scan("aaaaaaaa", False, PATTERN)) is None
    # scans that begin within one pre-token fall in behind it
    assert byte_bpe.sync_point([s - 1 for s in byte_bpe.scan("1234567 and so on", False, PATTERN) if s >= 1], byte_bpe.scan("234567 and so on", False, PATTERN)) == 6


def test_a_scan_that_agrees_with_its_neighbour_but_not_with_the_text():
    """Chunks behind a place without a common boundary count again only where the text's own scan agrees."""
    text = "a" * 40 + "1234567890" * 30 + " and then words follow here as usual" * 3
    size, overlap = 33, 9
    encode = byte_bpe.encoder(RANKS, PATTERN)[0].encode_ordinary
    n = -(-(len(text) - overlap) // size)
    chunks = [text[i * size : (i + 1) * size + overlap if i < n - 1 else len(text)] for i in range(n)]
    scans = [byte_bpe.scan(c, i == n - 1, PATTERN) for i, c in enumerate(chunks)]
    begins = [0] + [byte_bpe.sync_point([s - size for s in scans[i] if s >= size], scans[i + 1]) for i in range(n - 1)]
    assert None in begins and any(b is not None for b in begins[2:])
    parts = []
    for i, c in enumerate(chunks):
        end = begins[i + 1] if i < n - 1 else len(c) - size
        parts.append((c, begins[i], None if begins[i] is None or end is None else np.array(encode(c[begins[i] : size + end]), dtype="<u4").tobytes()))
    assert byte_bpe.stitch(parts, size, PATTERN, encode) == ids_of(text)


def test_query_is_the_tokenizer_of_every_document(spark, sf):
    from hashlib import sha256

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r.doc_id: r for r in byte_bpe.op1_byte_bpe(spark, sf).collect()}
    assert len(out) == len(docs)
    for d in docs:
        ids = ids_of(d.text)
        assert (out[d.doc_id].n_tokens, out[d.doc_id].ids_sha256, out[d.doc_id].decoded_sha256) == (len(ids) // 4, sha256(ids).hexdigest(), sha256((d.text or "").encode()).hexdigest())
