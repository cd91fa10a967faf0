"""Language-model scoring by a hierarchical Pitman-Yor model (operator 10).

Restaurants: every word that comes before another is a context with a restaurant of its own, however many there are; its dishes are
the words that follow it. All of them share the restaurant of single words as parent, which has the uniform distribution over the
words seen in training, and one more for all others, below it. The first word of a text follows the end of a text.

Seating is by Gibbs sampling from the seating before it: customers leave a dish (a table goes with the last of its customers, and
then its customer in the parent leaves too) and come back, to an old table or a new one by the parent's probability. Of the
seating of a dish only its numbers of customers and tables are kept; that a leaving customer sat alone has probability
S(c-1, t-1) / S(c, t), S being generalised Stirling numbers: exact up to CAP customers, by their saddle point beyond (2 % off at most). In a
sweep each customer of a dish leaves and comes back once; where a dish has more than STEPS customers, a STEPS-th of them at a time.
The chain starts with one table a dish. After BURN passes, SAMPLES seatings are taken, one a pass, and the predictive probabilities averaged over them.

Where it runs: pairs of words are dealt out by their hash, so a frequent word's pairs are everywhere and no task holds more than its share. The
totals that tie pairs together (tables of a context, customers and tables of a word) are kept by word, and brought up to date between passes: within a
pass every dish sees the others as they were at its start, and itself as it is. The word's own seating is drawn where its totals are.
Pairs that occur once have one table for good and only count in those totals. Nothing is sent row by row: words are numbered first (by 32 bits;
more words than these hold raise an error), then a task counts the pairs of a slice of texts and
sends one blob to each bucket of pairs; the answers come back in the order of the slice's pairs, so that they need no keys.

The number of buckets follows from the bytes of text, and the seeds from pass and bucket: scores depend on the rows alone, not on how they
or the shuffles are partitioned.

Defined results: a null or empty text is the end token alone; very long texts are one slice of their own; a null doc_id is not held out; without
training texts N = 0 and all tokens are unknown; an empty table has no scores; repeated rows count repeatedly; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import discard, materialise, materialise_kinds, table
from strataspan.llm.shingles import batches, mix, word_hashes

BURN, SAMPLES = 6, 4
STEPS, CAP = 32, 256
STRENGTH = 1.0
END = np.uint64(0xE5D1_0F7E_57A1_2C43)  # the end token's word
#: Text in a bucket of pairs, and tokens in a slice.
BUCKET_BYTES, SLICE = 12 << 20, 1 << 21


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word of every token with an end after each text, tokens of each text)."""
    h, bounds = word_hashes(texts)
    return np.insert(h, bounds[1:], END), np.diff(bounds) + 1


# -- blobs -------------------------------------------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes: the bytes of each place together, then zstd. Ascending unsigned arrays are stored as differences."""
    codec, out = pa.Codec("zstd", 1), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        rises = a.dtype.kind == "u" and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        body = np.concatenate([a[:1], np.diff(a)]) if rises else a
        body = codec.compress(body.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), asbytes=True) if len(a) else b""
        out.append(np.array([len(a), len(body), rises], "<i8").tobytes() + a.dtype.str.encode() + body)
    return b"".join(out)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(blob):
        n, size, rises = np.frombuffer(blob, "<i8", 3, at).tolist()
        kind = np.dtype(blob[at + 24 : at + 27].decode())
        at += 27
        if n:
            raw = codec.decompress(blob[at : at + size], n * kind.itemsize, asbytes=True)
            a = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()
            out.append(np.cumsum(a, dtype=kind) if rises else a)
        else:
            out.append(np.zeros(0, kind))
        at += size
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them all."""
    most = int(a.max(initial=0))
    return a.astype("|u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


# -- seating -----------------------------------------------------------------------------------------------------------


class Alone:
    """P(a customer sits alone) in a dish of c customers at t tables, for one discount."""

    def __init__(self, discount: float, cap: int = CAP):
        self.d, self.cap = discount, cap
        log = np.full((cap + 1, cap + 1), -np.inf)  # log S(c, t)
        log[0, 0] = 0.0
        for c in range(1, cap + 1):
            stay, weight = np.full(cap + 1, -np.inf), (c - 1) - discount * np.arange(cap + 1)
            ok = weight > 0
            stay[ok] = np.log(weight[ok]) + log[c - 1][ok]
            log[c] = np.logaddexp(stay, np.concatenate([[-np.inf], log[c - 1][:-1]]))
        self.exact = np.zeros((cap + 1, cap + 1))
        with np.errstate(invalid="ignore"):
            ratio = np.exp(log[:-1, :-1] - log[1:, 1:])
        self.exact[1:, 1:] = np.where(np.isfinite(ratio), ratio, 0.0)
        left = np.geomspace(1 - 1e-7, 1e-18, 4000)  # 1 - x at the saddle point x of ((1 - (1 - x)^d) / d)^t
        g = 1 - left**discount
        self.y, self.h = np.log((1 - left) * discount * left ** (discount - 1) / g), (1 - left) / g

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = self.exact[np.minimum(c, self.cap), np.minimum(t, self.cap)]
        big = np.flatnonzero(c > self.cap)
        if len(big):
            n, k = c[big] - 1.0, np.maximum(t[big] - 1.0, 0)
            part = self.d * k / n * np.interp(np.log(n / np.maximum(k, 0.5)), self.y, self.h)
            out[big] = np.where(k >= n, 1.0, np.minimum(part, 1.0))
        return out


def _draw(n: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Binomial draws; a uniform one each where n is 1."""
    out = (rng.random(len(n)) < p).astype(np.int64)
    many = np.flatnonzero(n != 1)
    if len(many):
        out[many] = rng.binomial(n[many], np.clip(p[many], 0, 1))
    return out


class Level:
    """The seating of dishes: c customers at t tables each."""

    def __init__(self, discount: float, strength: float = STRENGTH):
        self.d, self.strength, self.alone = discount, strength, Alone(discount)

    def leave(self, c: np.ndarray, t: np.ndarray, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables that go when k of c customers leave."""
        most = np.where(k < c, t - 1, t)
        return np.where(k < c, np.minimum(_draw(k, self.alone(c, t), rng), most), most)

    def join(self, c: np.ndarray, t: np.ndarray, k: np.ndarray, tables: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables that k customers open who join c at t, with so many tables in the restaurant and the parent's probability p."""
        fresh = (self.strength + self.d * tables) * p
        first = (c == 0) & (k > 0)
        rest = k - first
        born = _draw(rest, fresh / np.maximum(fresh + np.where(first, 1.0 - self.d, c - self.d * t), 1e-300), rng)
        return np.where(rest > 0, born, 0) + first

    def resize(self, old: np.ndarray, t: np.ndarray, new: np.ndarray, tables: float, p: float, rng: np.random.Generator) -> np.ndarray:
        """The tables after customers came or left one after another (a STEPS-th at a time in large dishes)."""
        c, t = old.copy(), t.copy()
        while True:
            at = np.flatnonzero(c > new)
            if not len(at):
                break
            k = np.minimum(c[at] - new[at], np.maximum(1, c[at] // STEPS))
            t[at] -= self.leave(c[at], t[at], k, rng)
            c[at] -= k
        while True:
            at = np.flatnonzero(c < new)
            if not len(at):
                break
            k = np.minimum(new[at] - c[at], np.maximum(1, c[at] // STEPS))
            t[at] += self.join(c[at], t[at], k, tables, np.full(len(at), p), rng)
            c[at] += k
        return t


def turns(c: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dishes, customers of each) that leave and come back together: every customer once, the dishes of a few at scattered times."""
    at = rng.integers(0, STEPS, len(c))
    for r in range(STEPS):
        k = ((r + 1 + at) * c) // STEPS - ((r + at) * c) // STEPS
        who = np.flatnonzero(k)
        if len(who):
            yield who, k[who]


def sweep_pairs(c, t, tables, word_c, word_t, level: Level, parent: Level, totals: tuple[int, int], base: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes after a sweep. tables: of the dish's restaurant; word_c, word_t: customers and tables of its word in the
    parent, whose customers and tables in all are `totals`; base: the probability below the parent."""
    t, tables, word_c, word_t = (np.array(a, dtype=np.int64) for a in (t, tables, word_c, word_t))
    root = (parent.strength + parent.d * totals[1]) * base
    for who, k in turns(c, rng):
        n, now = c[who], t[who]
        gone = level.leave(n, now, k, rng)
        wc, wt = word_c[who], word_t[who]
        wt = wt - np.where(gone > 0, parent.leave(wc, wt, np.minimum(gone, wc), rng), 0)
        wc, now, there = wc - gone, now - gone, tables[who] - gone
        p = (wc - parent.d * wt + root) / (parent.strength + totals[0] - gone)
        born = level.join(n - k, now, k, there, p, rng)
        wt = wt + np.where(born > 0, parent.join(wc, wt, born, np.full(len(who), totals[1]), np.full(len(who), base), rng), 0)
        t[who], tables[who], word_c[who], word_t[who] = now + born, there + born, wc + born, wt
    return t


def sweep_words(c: np.ndarray, t: np.ndarray, tables: int, parent: Level, base: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words in the parent after a sweep; `tables` of them in all."""
    t = t.copy()
    for who, k in turns(c, rng):
        gone = parent.leave(c[who], t[who], k, rng)
        now = t[who] - gone
        t[who] = now + parent.join(c[who] - k, now, k, tables - gone, np.full(len(who), base), rng)
    return t


def discount(ones: float, twos: float) -> float:
    """As in absolute discounting, of the numbers of dishes with one and two customers."""
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.1, 0.95))


# -- slices and counts -------------------------------------------------------------------------------------------------

#: kind 0: a slice's tokens, or the pair of each; kind 1: what goes to a bucket, of words at first and of pairs then.
SLICES = "kind int, src long, bucket int, data binary, doc_id array<long>, held_out array<boolean>"
#: kind 0: a bucket's pairs, or its words; kind 1: what it sends to a bucket of the other sort; kind 2: pairs that occur again, being seated.
ROWS = "kind int, bucket int, to int, data binary, src array<long>, places array<binary>, facts array<long>"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary())}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _stretches(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Where each value of an ascending array stands."""
    stops = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64), len(bucket))
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def _high(a: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits, which number the bucket."""
    return a >> a.dtype.type(8 * a.itemsize - bits) if bits else np.zeros(len(a), a.dtype)


def _slices(docs: DataFrame, bits: int) -> DataFrame:
    """The tokens of each slice by its own list of words, and these words with how often they occur in training."""

    def rows(src: int, ids: list, held: list[bool], words: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        x, which = np.unique(words, return_inverse=True)
        n = np.bincount(which[~np.repeat(np.array(held, bool), sizes)], minlength=len(x))
        out = [(0, src, None, squeeze(sizes.astype("<i8"), _narrow(which)), ids, held)]
        out += [(1, src, to, squeeze(x[s], _narrow(n[s])), None, None) for to, s in _stretches(_high(x, bits))]
        return _table(SLICES, out).to_batches()[0]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, made = TaskContext.get().partitionId(), 0
        ids, held, words, sizes, size = [], [], [], [], 0
        for batch in batches_:
            texts = batch.column(1).to_pylist()
            for part in batches(texts):
                h, n = tokens(texts[part])
                ids += batch.column(0)[part].to_pylist()
                held += batch.column(2)[part].to_pylist()
                words.append(h)
                sizes.append(n)
                size += len(h)
                if size >= SLICE:
                    yield rows((number << 32) + made, ids, held, np.concatenate(words), np.concatenate(sizes))
                    made += 1
                    ids, held, words, sizes, size = [], [], [], [], 0
        if ids:
            yield rows((number << 32) + made, ids, held, np.concatenate(words), np.concatenate(sizes))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, SLICES)


def _number_words(bits: int):
    """Words get numbers of 32 bits: their bucket, then their rank in it by count. The slices are told numbers and counts.
    facts: tokens, words seen in training, words."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        srcs, parts = rows.column("src").to_pylist(), [unsqueeze(b) for b in rows.column("data").to_pylist()]
        x, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        if len(x) > 1 << (32 - bits):
            raise ValueError("more words than there are numbers")
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(x)).astype(np.int64)
        number = np.empty(len(x), np.uint32)
        number[np.lexsort((x, -n))] = np.arange(len(x), dtype=np.uint32) + np.uint32(bucket << (32 - bits) if bits else 0)
        ends = np.cumsum([len(p[0]) for p in parts])
        out = [(0, bucket, None, None, None, None, [int(n.sum()), int((n > 0).sum()), len(x)])]
        for src, a, b in zip(srcs, np.concatenate([[0], ends[:-1]]), ends, strict=True):
            out.append((1, bucket, None, squeeze(number[at[a:b]], _narrow(n[at[a:b]])), [src], None, None))
        return _table(ROWS, out)

    return run


def _slice_pairs(bits: int, n_tokens: int, n_types: int):
    """The pairs of a slice to their buckets; in the slice stays which pair each token is, with what its documents' words give."""

    def run(head: pa.Table, answers: pa.Table) -> pa.Table:
        src, ids, held = (head.column(c)[0].as_py() for c in ("src", "doc_id", "held_out"))
        sizes, which = unsqueeze(head.column("data")[0].as_py())
        got = [unsqueeze(b) for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))]
        number, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1].astype(np.int64) for g in got])
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((n + 1) / (n_tokens + n_types + 1))[which], starts)
        known = np.add.reduceat((n > 0)[which].astype(np.int64), starts)
        word = number[which]
        context = np.concatenate([word[-1:], word[:-1]])  # every text ends with the end token
        keys = context.astype(np.uint64) << np.uint64(32) | word
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        cut = np.flatnonzero(new)
        pair = ordered[cut]
        count = np.add.reduceat((~np.repeat(np.array(held, bool), sizes))[order].astype(np.int64), cut)
        bucket = _high(mix(pair + np.uint64(1)), bits)
        dealt = np.argsort(bucket.astype(np.uint16 if bits <= 16 else np.uint64), kind="stable")
        place = np.empty(len(cut), np.uint32)
        place[dealt] = np.arange(len(cut), dtype=np.uint32)
        which = np.empty(len(keys), np.uint32)
        which[order] = place[np.cumsum(new) - 1]
        out = [(0, src, None, squeeze(sizes, which, base.view("<u8"), _narrow(known)), ids, held)]
        for to, s in _stretches(bucket[dealt]):
            p = pair[dealt[s]]
            out.append((1, src, to, squeeze((p >> np.uint64(32)).astype("<u4"), p.astype("<u4"), _narrow(count[dealt[s]])), None, None))
        return _table(SLICES, out)

    return run


def _count_pairs(bits: int):
    """The pairs of a bucket, and where each slice's pairs are among them; facts: how many there are, and occur once and twice, in training."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, srcs = rows.column("bucket")[0].as_py(), rows.column("src").to_pylist()
        parts = [unsqueeze(b) for b in rows.column("data").to_pylist()]
        ends = np.cumsum([len(p[0]) for p in parts])
        keys = np.concatenate([p[0].astype(np.uint64) << np.uint64(32) | p[1] for p in parts])
        n = np.concatenate([p[2].astype(np.int64) for p in parts])
        del parts
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        cut = np.flatnonzero(new)
        place = np.empty(len(keys), np.uint32)
        place[order] = np.cumsum(new) - 1
        c, pair = np.add.reduceat(n[order], cut), ordered[cut]
        places = [squeeze(_narrow(np.diff(place[a:b], prepend=np.uint32(0)))) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]  # they ascend
        context, word = (pair >> np.uint64(32)).astype("<u4"), pair.astype("<u4")
        words, vi, wi = _listed(context, word)
        total = lambda index, x: np.bincount(index, x, len(words)).astype(np.int64)
        once, again = c == 1, c > 1
        sums = [total(vi, c), total(vi, once), total(wi, once), total(wi, again)]
        out = [(0, bucket, None, squeeze(context, word, _narrow(c)), srcs, places, [len(c), int(once.sum()), int((c == 2).sum())])]
        out += [(1, bucket, to, squeeze(words[s], *(_narrow(x[s]) for x in sums)), None, None, None) for to, s in _stretches(_high(words, bits))]
        m = np.flatnonzero(again)
        out.append((2, bucket, None, squeeze(context[m], word[m], _narrow(c[m]), np.ones(len(m), "|u1"), np.zeros(len(m), "|u1")), None, None, None))
        return _table(ROWS, out)

    return run


def _listed(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of pairs, ascending, and where those of each pair are."""
    words, at = np.unique(np.concatenate([context, word]), return_inverse=True)
    return words, at[: len(context)], at[len(context) :]


# -- passes ------------------------------------------------------------------------------------------------------------


def _rank(words: np.ndarray, bits: int) -> np.ndarray:
    return words & np.uint32((1 << (32 - bits)) - 1)


def _first_words(bits: int):
    """The state of a bucket of words: customers as a context, tables there of pairs that occur once, customers of such pairs,
    customers, tables; facts: customers, tables, words with one and two customers."""

    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        size = state.column("facts")[0].as_py()[2]
        parts = [unsqueeze(b) for b in asks.column("data").to_pylist()]
        at = _rank(np.concatenate([p[0] for p in parts]), bits)
        total, t_once, c_once, c_again = (np.bincount(at, np.concatenate([p[i] for p in parts]), size).astype(np.int64) for i in range(1, 5))
        c = c_once + c_again
        t = np.minimum(c, 1)
        facts = [int(c.sum()), int(t.sum()), int((c == 1).sum()), int((c == 2).sum())]
        return _table(ROWS, [(0, state.column("bucket")[0].as_py(), None, squeeze(*map(_narrow, (total, t_once, c_once, c, t))), None, None, facts)])

    return run


def _word_pass(number: int, bits: int, tables: int, parent: Level, base: float, keep: bool):
    """Words are seated again; facts: their customers and tables. The buckets of pairs are told tables as a context, customers and tables."""

    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        bucket = state.column("bucket")[0].as_py()
        total, t_once, c_once, c_old, t_old, *samples = (a.astype(np.int64) for a in unsqueeze(state.column("data")[0].as_py()))
        there, c, found = t_once.copy(), c_once.copy(), []
        for to, blob in sorted(zip(asks.column("bucket").to_pylist(), asks.column("data").to_pylist(), strict=True)):
            words, t, customers = unsqueeze(blob)
            at = _rank(words, bits)
            there[at] += t.astype(np.int64)
            c[at] += customers.astype(np.int64)
            found.append((to, at))
        rng = np.random.Generator(np.random.PCG64([1, number, bucket]))
        t = parent.resize(c_old, t_old, c, tables, base, rng)
        t = sweep_words(c, t, tables, parent, base, rng)
        if keep:
            samples += [there, c, t]
        rows = [(0, bucket, None, squeeze(*map(_narrow, (total, t_once, c_once, c, t, *samples))), None, None, [int(c.sum()), int(t.sum())])]
        rows += [(1, bucket, to, squeeze(*(_narrow(a[at]) for a in (there, c, t))), None, None, None) for to, at in found]
        return _table(ROWS, rows)

    return run


def _pair_pass(number: int, bits: int, level: Level, parent: Level, totals: tuple[int, int], base: float, keep: bool):
    """Pairs that occur again are seated again."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = state.column("bucket")[0].as_py()
        context, word, c, t, t_sum = unsqueeze(state.column("data")[0].as_py())
        words, vi, wi = _listed(context, word)
        got = [unsqueeze(b) for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))]
        if got:
            there, word_c, word_t = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(3))
            rng = np.random.Generator(np.random.PCG64([2, number, bucket]))
            t = sweep_pairs(c.astype(np.int64), t, there[vi], word_c[wi], word_t[wi], level, parent, totals, base, rng)
        t_sum = t_sum.astype(np.int64) + t.astype(np.int64) * keep
        return _table(ROWS, [(2, bucket, None, squeeze(context, word, c, _narrow(t), _narrow(t_sum)), None, None, None), *_asks(bucket, words, vi, wi, t, bits)])

    return run


def _asks(bucket: int, words: np.ndarray, vi: np.ndarray, wi: np.ndarray, t: np.ndarray, bits: int) -> list[tuple]:
    """To each bucket of words: the words of pairs that occur again, their tables as contexts and customers as words."""
    tables, customers = (np.bincount(i, t, len(words)).astype(np.int64) for i in (vi, wi))
    return [(1, bucket, to, squeeze(words[s], _narrow(tables[s]), _narrow(customers[s])), None, None, None) for to, s in _stretches(_high(words, bits))]


def _first_asks(bits: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                context, word, _, t, _ = unsqueeze(blob)
                words, vi, wi = _listed(context, word)
                yield from _table(ROWS, _asks(bucket, words, vi, wi, t, bits)).to_batches()

    return run


# -- the model and its scores ------------------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _last_answers(bits: int):
    """To each bucket of pairs, of all its words: customers as a context, and of each sample tables there, customers and tables."""

    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        total, _, _, _, _, *samples = unsqueeze(state.column("data")[0].as_py())
        bucket, out = state.column("bucket")[0].as_py(), []
        for to, blob in zip(asks.column("bucket").to_pylist(), asks.column("data").to_pylist(), strict=True):
            at = _rank(unsqueeze(blob)[0], bits)
            out.append((1, bucket, to, squeeze(*(_narrow(a[at]) for a in (total, *samples))), None, None, None))
        return _table(ROWS, out)

    return run


def _predict(level: Level, parent: Level, totals: list[tuple[int, int]], base: float):
    """Answers to the slices: log10 of the averaged predictive probability of each of their pairs."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, data = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
        me = kinds.index(0)
        context, word, c = unsqueeze(data[me])
        c = c.astype(np.int64)
        _, vi, wi = _listed(context, word)
        t_sum = np.minimum(c, 1) * len(totals)  # of pairs that occur once
        t_sum[c > 1] = unsqueeze(data[kinds.index(2)])[4]
        got = [unsqueeze(b) for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))]
        got = [np.concatenate([g[i] for g in got]).astype(np.float64) for i in range(1 + 3 * len(totals))]
        p = np.zeros(len(c))
        for k, (customers, tables) in enumerate(totals):
            there, word_c, word_t = got[1 + 3 * k : 4 + 3 * k]
            single = (word_c - parent.d * word_t + (parent.strength + parent.d * tables) * base) / (parent.strength + customers)
            p += (level.strength + level.d * there)[vi] * single[wi]
        p = (len(totals) * c - level.d * t_sum + p) / len(totals) / (level.strength + got[0][vi])
        log, bucket, out = np.log10(p).astype("<f4").view("<u4"), rows.column("bucket")[0].as_py(), []
        for src, blob in zip(rows.column("src")[me].as_py(), rows.column("places")[me].as_py(), strict=True):
            out.append((1, src, bucket, squeeze(log[np.cumsum(unsqueeze(blob)[0], dtype=np.int64)]), None, None))
        return _table(SLICES, out)

    return run


def _by_document(n_tokens: int):
    def run(head: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, which, base, known = unsqueeze(head.column("data")[0].as_py())
        got = [unsqueeze(b)[0] for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))]
        score = np.add.reduceat(np.concatenate(got).view("<f4").astype(np.float64)[which], np.cumsum(sizes) - sizes)
        cols = [head.column("doc_id")[0].as_py(), head.column("held_out")[0].as_py(), sizes, known.astype(np.int64), np.full(len(sizes), n_tokens), base.view("<f8"), score, 10 ** np.minimum(-score / sizes, 300)]
        fields = [f.split(" ") for f in SCORES.split(", ")]
        return pa.table([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], names=[name for name, _ in fields])

    return run


def _facts(rows: DataFrame, n: int) -> list[int]:
    """The sums of `n` numbers over buckets."""
    return [x or 0 for x in rows.where("kind = 0").agg(*(F.sum(F.col("facts")[i]) for i in range(n))).first()]


def score(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES, strength: float = STRENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of all docs (doc_id, text, held_out) by the model of those that are not held out. burn is 1 at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    n = 1 << bits
    # few rows with much work each: as many partitions as buckets, which adaptive execution leaves alone
    dealt = lambda rows, by: rows.repartition(n, by).groupBy(by)
    sent = lambda rows, by: rows.where("kind = 1").select(F.col(by).alias("_to"), "bucket", "data")
    kept = lambda rows, *more: rows.where("kind = 0").select(F.col("bucket").alias("_to"), "kind", "bucket", "data", *more)
    together = lambda left, right, work, schema=ROWS: dealt(left, "_to").cogroup(dealt(right, "_to")).applyInArrow(work, schema)

    texts, listed = materialise_kinds(_slices(docs, bits), "lm-tokens", "kind", (0, 1))
    numbered = materialise(dealt(listed.select("src", "bucket", "data"), "bucket").applyInArrow(_number_words(bits), ROWS), "lm-numbers")
    n_tokens, n_types = _facts(numbered, 2)
    by_slice = texts.groupBy("src").cogroup(sent(numbered, "src").withColumn("_to", F.col("_to")[0]).groupBy("_to"))
    heads, pairs = materialise_kinds(by_slice.applyInArrow(_slice_pairs(bits, n_tokens, n_types), SLICES), "lm-slices", "kind", (0, 1))
    discard(texts, listed)
    counted = materialise(dealt(pairs.select("src", "bucket", "data"), "bucket").applyInArrow(_count_pairs(bits), ROWS), "lm-pairs")
    discard(pairs)
    _, ones, twos = _facts(counted, 3)
    asked = sent(counted, "to")
    words = materialise(together(kept(numbered, "facts"), asked, _first_words(bits)), "lm-words")
    discard(numbered)
    customers, tables, one, two = _facts(words, 4)
    level, parent, base = Level(discount(ones, twos), strength), Level(discount(one, two), strength), 1 / (n_types + 1)
    state = counted.where("kind = 2").select(F.col("bucket").alias("_to"), "bucket", "data")
    asks = sent(state.select("bucket", "data").mapInArrow(_first_asks(bits), ROWS), "to")
    totals, old = [], []
    for k in range(burn + samples):
        keep, before = k >= burn, words
        words = materialise(together(kept(words), asks, _word_pass(k, bits, tables, parent, base, keep)), "lm-words")
        discard(before)
        customers, tables = _facts(words, 2)
        totals += [(customers, tables)] * keep
        if k == burn + samples - 1:
            break
        # the seating that a sample's totals belong to is the one before them
        seated = materialise(together(state, sent(words, "to"), _pair_pass(k, bits, level, parent, (customers, tables), base, k + 1 >= burn)), "lm-seated")
        discard(*old)
        old = [seated]
        state, asks = seated.where("kind = 2").select(F.col("bucket").alias("_to"), "bucket", "data"), sent(seated, "to")
    last = materialise(together(kept(words), asked, _last_answers(bits)), "lm-last")
    discard(words)
    mine = kept(counted, "src", "places").unionByName(state.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    found = materialise(together(mine, sent(last, "to"), _predict(level, parent, totals, base), SLICES), "lm-answers")
    discard(counted, last, *old)
    return heads.groupBy("src").cogroup(found.groupBy("src")).applyInArrow(_by_document(n_tokens), SCORES)


def op10_pitman_yor(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
