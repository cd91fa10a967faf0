"""Token-id output in binary shards, compressed by a Re-Pair grammar (operator 9).

Documents are dealt out by ranges of doc_id and sorted, so shards in order of (range, number) hold all ids in ascending doc_id order.
Within a shard, frequent pairs of neighbouring ids are replaced by nonterminals, many distinct pairs a round, until no rule pays any more: it
takes RULE bytes, and each use of it saves a symbol. Symbols have 2 bytes while that is enough; when these run out, they get 4 if the pairs that
are left would shorten the sequence by more than half, else the grammar is complete. There is no limit of rounds. The shard keeps the rules, the length that each nonterminal expands to, the compressed sequence and an
index of documents. Expansion lengths let a range of ids be decoded without the rest of the shard. Shards are rows of Parquet files in the shared folder:
they are written and found again by Spark in whatever store that is.

Text is encoded word by word, each distinct word of a batch once and by the library, with a bounded table of words met before, where the tokenizer
provably works word by word (texts of printable ASCII and Latin letters without strings of special tokens); any other text goes
to the tokenizers library whole. Words are told apart by a 64-bit hash, among the few million that the table holds.

A shard: magic RPAIR1, then little-endian unsigned 32-bit: documents, rules, sequence length, ids, bytes a symbol (2 or 4), first
nonterminal; then int64 doc_ids (with a byte each that is 1 for a null), uint32 counts, rules as pairs of uint32, uint32 expansion lengths, the sequence.

Texts are dealt out as they are and encoded where their shard is: ids of 2 bytes take no less room in a shuffle than compressed text, and encoding
first would either encode twice (ranges are sampled) or write all ids once more.

Defined results: a null or empty text has only the end id; equal doc_ids stand in order of their text, repeated rows next to each other; a null doc_id comes first; very long
texts are encoded whole; an empty table has no shards; columns other than those named are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import materialise, shuffle_partitions, table

MAGIC = b"RPAIR1"
SHARD_IDS = 4_000_000
A_ROUND = 4096
#: Bytes of a rule: two symbols and a length.
RULE = 12
CACHE_IDS = 12_000_000

#: ASCII and Latin letters: lower case is one character each, normal form C changes nothing, digits are 0-9 only.
SAFE = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba-\u00bb\u00bf-\u012f\u0131-\u0148\u014a-\u017e]*")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if c in (9, 10, 11, 12, 13, 32) else _LETTER if chr(c).isalpha() else _DIGIT if 48 <= c <= 57 else _OTHER for c in range(0x180)], dtype=np.uint8)
_rng = np.random.Generator(np.random.PCG64(20230517))
_CHAR = _rng.integers(1, 2**63, 0x180, dtype=np.uint64) | np.uint64(1)


def split_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the tokenizer's words in a lower-case text of SAFE characters: runs of letters, single digits, runs of
    other characters, and 's 't 'm 'd 're 've 'll where a word begins with the apostrophe."""
    c = np.frombuffer((text + "   ").encode("utf-16-le"), dtype="<u2")
    kind = _KIND[c]
    begins = (kind != _SPACE) & ((kind != np.concatenate([[_SPACE], kind[:-1]])) | (kind == _DIGIT))
    at = np.flatnonzero(begins & (c == 39))
    if len(at):
        one, two = c[at + 1], c[at + 2]
        size = np.where(np.isin(one, np.frombuffer("stmd".encode("utf-16-le"), "<u2")), 2, 0)
        for first, second in ("re", "ve", "ll"):
            size[(one == ord(first)) & (two == ord(second))] = 3
        at, size = at[size > 0], size[size > 0]
        begins[at + 1] = False
        after = at + size
        begins[after[kind[after] == _LETTER]] = True
    solid = np.flatnonzero(kind != _SPACE)
    first = np.flatnonzero(begins[solid])
    return solid[first], np.diff(np.append(first, len(solid)))


def hash_words(text: str, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    from strataspan.llm.shingles import _power, mix

    c = np.frombuffer(text.encode("utf-16-le"), dtype="<u2")
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    body = _CHAR[c[np.repeat(start, length) + within]] * _power(int(length.max()) + 1)[within]
    return mix(np.add.reduceat(body, first) + length.astype(np.uint64))


class Words:
    """The ids of words by their hash: a large sorted table and a small one of late additions."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.levels = [(np.zeros(0, np.uint64), none, none)] * 2
        self.flat = np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset in flat, number of ids) of each hash; number 0 if it isn't known."""
        offset, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, o, n in self.levels:
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                offset[hit], count[hit] = o[at[hit]], n[at[hit]]
        return offset, count

    def add(self, h: np.ndarray, words: list[str]) -> None:
        """Words (ascending hashes) as the library encodes them in one text; a word's last id ends with the suffix."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        start = np.concatenate([[0], stop[:-1]])
        old, late = self.levels
        k, o, n = (np.concatenate(x) for x in zip(late, (h, start + len(self.flat), stop - start), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        if len(k) > 1 << 17:
            k, o, n = (np.concatenate(x) for x in zip(old, (k, o, n), strict=True))
            order = np.argsort(k)
            self.levels = [(k[order], o[order], n[order]), (k[:0], o[:0], n[:0])]
        else:
            order = np.argsort(k)
            self.levels = [old, (k[order], o[order], n[order])]


@lru_cache(2)
def _words(path: str) -> Words:
    return Words(path)


def _encode_safe(texts: list[str], known: Words) -> list[np.ndarray]:
    """The ids of texts that are encoded word by word."""
    low = "\n".join(texts).lower()
    start, length = split_words(low)
    if not len(start):
        return [np.zeros(0, np.uint32)] * len(texts)
    h, which = np.unique(hash_words(low, start, length), return_inverse=True)
    offset, count = known.find(h)
    new = np.flatnonzero(count == 0)
    if len(new):
        some = np.empty(len(h), np.int64)
        some[which] = np.arange(len(which))
        at = some[new]
        if len(known.flat) > CACHE_IDS:
            known.clear()
            return _encode_safe(texts, known)
        known.add(h[new], [low[a : a + n] for a, n in zip(start[at].tolist(), length[at].tolist(), strict=True)])
        offset, count = known.find(h)
    offset, count = offset[which], count[which]
    stop = np.cumsum(count)
    ids = known.flat[np.repeat(offset - (stop - count), count) + np.arange(stop[-1])]
    ends = np.cumsum([len(t) + 1 for t in texts])  # lower case keeps lengths
    words_before = np.searchsorted(start, ends)
    ids_before = np.concatenate([[0], stop])[words_before]
    return np.split(ids, ids_before[:-1])


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """The ids of every text with the end id, as the tokenizers library gives them."""
    known = _words(path)
    out: list = [None] * len(texts)
    safe = [i for i, t in enumerate(texts) if "<|" not in (t or "") and SAFE.fullmatch(t or "")]
    for i, ids in zip(safe, _encode_safe([texts[i] or "" for i in safe], known), strict=True):
        out[i] = ids
    for i in set(range(len(texts))).difference(safe):
        out[i] = np.array(known.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
    return [np.append(x, np.uint32(end_id)).astype("<u4") for x in out]


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of ascending positions with these ranks remain where neighbours overlap: those of a smaller rank than both, and every other
    one of a run of one rank."""
    if not len(at):
        return np.zeros(0, bool)
    near = np.diff(at) == 1
    run = np.concatenate([[True], ~(near & (rank[1:] == rank[:-1]))])
    first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    key = 2 * rank.astype(np.int64) + (np.arange(len(at)) - first) % 2
    less = key[1:] < key[:-1]
    keep = np.ones(len(at), bool)
    keep[1:] &= ~near | less
    keep[:-1] &= ~near | ~less & (key[1:] != key[:-1])
    return keep


SLOT_BITS = 18


def _slot(keys: np.ndarray) -> np.ndarray:
    """A small hash of pairs, for a lookup of one step."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _pairs(seq: np.ndarray, base) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the pair at each place, the distinct pairs, how often each occurs)."""
    keys = seq[:-1] * base + seq[1:]
    ordered = np.sort(keys)
    cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return keys, ordered[cut], np.diff(np.append(cut, len(ordered)))


def compress(ids: np.ndarray, a_round: int = A_ROUND) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, rules, expansion lengths, sequence). Rule k stands for symbol first + k."""
    first = int(ids.max(initial=0)) + 1
    width = 2 if first < 1 << 16 else 4
    seq, rules, lengths, made = ids.astype(np.uint32 if width == 2 else np.uint64), [], np.ones(first, dtype=np.int64), 0
    while len(seq) > 1:
        kind = seq.dtype.type
        keys, pairs_, count = _pairs(seq, kind(1 << 16 if width == 2 else 1 << 32))
        room = (1 << 16 if width == 2 else 1 << 31) - first - made
        double = pairs_ // kind(1 << 16 if width == 2 else 1 << 32) == pairs_ % kind(1 << 16 if width == 2 else 1 << 32)
        count = np.where(double, (count + 1) // 2, count)  # xx overlaps itself
        often = np.flatnonzero(count * width > RULE)
        if width == 2 and not room:
            if 2 * (count[count * 4 > RULE] - 1).sum() <= len(seq):
                break
            width, seq = 4, seq.astype(np.uint64)
            continue
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")[: min(a_round, room)]]
        chosen = pairs_[often]
        _, alone = np.unique(_slot(chosen), return_index=True)  # one pair for each slot, the most frequent; others may come next round
        chosen = chosen[np.sort(alone)]
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        slots[_slot(chosen)] = np.arange(len(chosen))
        at = slots[_slot(keys)]
        hit = np.flatnonzero(chosen[at] == keys)
        hit = hit[_apart(hit, at[hit])]
        used, uses = np.unique(at[hit], return_counts=True)
        pays = used[uses * width > RULE]  # uses that overlap those of more frequent pairs are lost; the first pair loses none
        number = np.full(len(chosen), -1)
        number[pays] = np.arange(len(pays))
        hit = hit[number[at[hit]] >= 0]
        symbol = number[at[hit]]
        base = kind(1 << 16 if width == 2 else 1 << 32)
        pairs = np.stack([chosen[pays] // base, chosen[pays] % base], axis=1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0].astype(np.int64)] + lengths[pairs[:, 1].astype(np.int64)]])
        seq = seq.copy()
        seq[hit] = (first + made + symbol).astype(kind)
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq = seq[keep]
        made += len(pays)
    table_ = np.concatenate(rules).astype("<u4") if rules else np.zeros((0, 2), "<u4")
    return first, table_, lengths[first:].astype("<u4"), seq


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard."""
    all_ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    first, rules, lengths, seq = compress(all_ids)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<6I", len(ids), len(rules), len(seq), len(all_ids), width, first)
    index = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([MAGIC, head, index, np.array([len(x) for x in ids], dtype="<u4").tobytes(), rules.tobytes(), lengths.tobytes(), seq.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard as it was read."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, rules, n, self.n_ids, width, self.first = struct.unpack_from("<6I", blob, len(MAGIC))
        at = len(MAGIC) + 24
        ids = np.frombuffer(blob, "<i8", docs, at).tolist()
        none = blob[at + 8 * docs : at + 9 * docs]
        self.doc_ids = [None if z else d for d, z in zip(ids, none, strict=True)]
        at += 9 * docs
        self.counts = np.frombuffer(blob, "<u4", docs, at)
        at += 4 * docs
        self.rules = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(blob, "<u4", rules, at)
        self.seq = np.frombuffer(blob, f"<u{width}", n, at + 4 * rules)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        offset = np.concatenate([[0], np.cumsum(sizes[self.first :])])
        flat = np.zeros(offset[-1], dtype="<u4")  # what each rule expands to
        for k, (a, b) in enumerate(self.rules.tolist()):
            o = offset[k]
            for s in (a, b):
                if s < self.first:
                    flat[o] = s
                    o += 1
                else:
                    i = s - self.first
                    part = flat[offset[i] : offset[i + 1]]
                    flat[o : o + len(part)] = part
                    o += len(part)
        n = sizes[seq]
        start = np.cumsum(n) - n
        out = np.repeat(seq, n).astype("<u4")
        big = np.flatnonzero(seq >= self.first)
        within = np.arange(int(n[big].sum())) - np.repeat(np.cumsum(n[big]) - n[big], n[big])
        out[np.repeat(start[big], n[big]) + within] = flat[np.repeat(offset[seq[big] - self.first], n[big]) + within]
        return out

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def slice(self, start: int, count: int) -> np.ndarray:
        """`count` ids from `start` on; only the symbols that cover them are expanded."""
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])[self.seq.astype(np.int64)]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.seq[a:b])[start - before : start - before + count]


SHARDS = "part int, ordinal int, n_ids long, shard binary"


def write_shards(docs: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode docs (doc_id, text) and write their shards; the DataFrame reads the files: (part, ordinal, n_ids, shard).
    path: a file of the tokenizers library. Shards in order of (part, ordinal) are in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, ordinal = [], [], 0, 0
        part = None

        def flush():
            nonlocal ids, held, size, ordinal
            blob = pack(ids, held)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([ordinal], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "ordinal", "n_ids", "shard"])
            ids, held, size, ordinal = [], [], 0, ordinal + 1
            return row

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                part = some.column(2)[0].as_py()
                for d, x in zip(some.column(0).to_pylist(), encode_texts(some.column(1).to_pylist(), path, end_id), strict=True):
                    if size and size + len(x) > shard_ids:
                        yield flush()
                    ids.append(d)
                    held.append(x)
                    size += len(x)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    return materialise(rows.mapInArrow(run, SHARDS), "token-shards")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    spark = shards.sparkSession
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each range
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    offset = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    w = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "ordinal", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(offset, "part")
    starts = starts.select("part", "ordinal", (F.col("before") + F.col("inner")).alias("start"))  # one small row for each shard
    placed = shards.join(starts, ["part", "ordinal"]).select("start", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, shard = batch.column(0)[row].as_py(), Shard(batch.column(1)[row].as_py())
                ids, ends = shard.ids(), np.cumsum(shard.counts, dtype=np.int64)
                begins = ends - shard.counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + at), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, READ)


def op9_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocab.path("word_bpe_49k.json"), end_id=2))
