"""The hierarchical Pitman-Yor model against a sampler that seats one customer after another, and its contract."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.llm import pitman_yor as py


def one_by_one(pairs, d1, d2, strength, sweeps, burn, seed):
    """Mean predictive probabilities of all (context, word): tables with their sizes, customers moved singly."""
    r, low, top, c2, t2 = random.Random(seed), defaultdict(list), defaultdict(list), Counter(), Counter()
    words, contexts = sorted({w for _, w in pairs}), sorted({v for v, _ in pairs})
    base, total = 1 / (len(words) + 1), [0, 0]

    def single(w):
        return (sum(low[w]) - d1 * len(low[w]) + (strength + d1 * total[1]) * base) / (strength + total[0])

    def join(tables, d, fresh):
        i = r.choices(range(len(tables) + 1), [n - d for n in tables] + [fresh])[0]
        if i == len(tables):
            tables.append(0)
        tables[i] += 1
        return tables[i] == 1

    def leave(tables):
        i = r.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        return tables[i] == 0 and tables.pop(i) == 0

    def move(v, w, way):
        if way > 0 and join(top[v, w], d2, (strength + d2 * t2[v]) * single(w)):
            t2[v], total[1], total[0] = t2[v] + 1, total[1] + join(low[w], d1, (strength + d1 * total[1]) * base), total[0] + 1
        elif way < 0 and leave(top[v, w]):
            t2[v], total[0], total[1] = t2[v] - 1, total[0] - 1, total[1] - leave(low[w])
        c2[v] += way

    for v, w in pairs:
        move(v, w, 1)
    out = np.zeros((len(contexts), len(words)))
    for s in range(sweeps):
        for v, w in pairs:
            move(v, w, -1)
            move(v, w, 1)
        if s >= burn:
            p = np.array([single(w) for w in words])
            out += [[(sum(top[v, w]) - d2 * len(top[v, w]) + (strength + d2 * t2[v]) * p[j]) / (strength + c2[v]) for j, w in enumerate(words)] for v in contexts]
    return out / (sweeps - burn)


def in_passes(pairs, d1, d2, strength, sweeps, burn, seed):
    """The same by the operator's passes: all pairs at once, then all words."""
    contexts, words, count = sorted({v for v, _ in pairs}), sorted({w for _, w in pairs}), Counter(pairs)
    cells = sorted(count)
    v, w, c = np.array([contexts.index(a) for a, _ in cells]), np.array([words.index(b) for _, b in cells]), np.array([count[x] for x in cells])
    level, parent, base, again = py.Level(d2, strength), py.Level(d1, strength), 1 / (len(words) + 1), np.flatnonzero(c > 1)
    t = np.ones(len(c), np.int64)
    word_c = np.bincount(w, t).astype(np.int64)
    word_t, out = np.minimum(word_c, 1), np.zeros((len(contexts), len(words)))
    tables = int(word_t.sum())
    for s in range(sweeps):
        rng = np.random.Generator(np.random.PCG64([seed, s]))
        there, new = np.bincount(v, t, len(contexts)).astype(np.int64), np.bincount(w, t).astype(np.int64)
        word_t = parent.resize(word_c, word_t, new, tables, base, rng)
        word_c, word_t = new, py.sweep_words(new, word_t, tables, parent, base, rng)
        tables = int(word_t.sum())
        if s >= burn:
            single = (word_c - d1 * word_t + (strength + d1 * tables) * base) / (strength + word_c.sum())
            p = (strength + d2 * there)[:, None] * single
            p[v, w] += c - d2 * t
            p /= strength + np.bincount(v, c)[:, None]
            unknown = (strength + d2 * there) / (strength + np.bincount(v, c)) * (strength + d1 * tables) * base / (strength + word_c.sum())
            assert np.allclose(p.sum(axis=1) + unknown, 1)  # a distribution, each sample
            out += p
        t[again] = py.sweep_pairs(c[again], t[again], there[v[again]], word_c[w[again]], word_t[w[again]], level, parent, (int(word_c.sum()), tables), base, rng)
        assert (t >= 1).all() and (t <= c).all() and (word_t >= 1).all() and (word_t <= word_c).all()
    return out / (sweeps - burn)


@pytest.mark.parametrize("d1,d2,strength", [(0.5, 0.7, 1.0), (0.8, 0.4, 3.0)])
def test_seating_agrees_with_one_by_one(d1, d2, strength):
    tiny = [("a", "x")] * 3 + [("b", "x")] * 2 + [("a", "y")] * 4 + [("b", "z")] + [("c", "x")] * 5 + [("c", "y")] * 2
    more = [(f"v{i * 7 % 5}", f"w{i * i % 11}") for i in range(400)]
    for pairs, sweeps in ((tiny, 600), (more, 200)):
        want, got = (np.mean([f(pairs, d1, d2, strength, sweeps, 50, seed) for seed in range(2)], axis=0) for f in (one_by_one, in_passes))
        assert np.abs(got / want - 1).max() < 0.06 and np.abs(got - want).max() < 0.01


@pytest.mark.parametrize("d", [0.3, 0.6, 0.9])
def test_alone(d):
    """Exact against all partitions of a few customers; the asymptotic form against the exact one."""

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            yield [*rest, 1]
            for i in range(len(rest)):
                yield rest[:i] + [rest[i] + 1] + rest[i + 1 :]

    weight, alone = Counter(), Counter()
    for p in partitions(6):
        w = math.prod(math.prod(k - d for k in range(1, n)) for n in p)
        weight[len(p)] += w
        alone[len(p)] += w * p.count(1) / 6
    a = py.Alone(d)
    t = np.arange(1, 7)
    assert np.allclose(a(np.full(6, 6), t), [alone[k] / weight[k] for k in t])
    few, t = py.Alone(d, cap=128), np.arange(3, 200)
    c = np.full(len(t), 256)
    assert np.abs(few(c, t) / a(c, t) - 1).max() < 0.08 and np.abs(few(c, t) - a(c, t)).max() < 0.005


def test_blobs():
    rng = np.random.Generator(np.random.PCG64(3))
    arrays = [np.zeros(0, "<u4"), np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), rng.integers(0, 9, 77).astype("|u1"), np.array([-5, 7], "<i8"), np.arange(300, dtype="<u2")]
    back = py.unsqueeze(py.squeeze(*arrays))
    assert len(back) == len(arrays) and all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]


def test_contract(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r.doc_id: r for r in py.op10_pitman_yor(spark, sf).collect()}
    count = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    n, v, model, base = sum(count.values()), len(count), 0.0, 0.0
    for d, t in docs:
        w, r = words(t), out[d]
        want = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - want) < 1e-9 * abs(want) and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity
        if r.held_out:
            model, base = model + r.score, base + r.base_score
    assert model > 0.95 * base
    # training documents that occur twice are told from those that occur once
    times = Counter(t for d, t in docs if not out[d].held_out)
    rate = lambda k: np.median([out[d].score / out[d].n_tokens for d, t in docs if not out[d].held_out and (times[t] > 1) == k and out[d].n_tokens > 50])
    assert rate(True) > rate(False) + 0.2


def test_scores_do_not_follow_partitions(spark):
    rows = [(i, f"the cat {i % 7} sat on the mat {i % 3} " * (1 + i % 4) + f"word{i} and more", i % 7 == 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for shuffle, parts in ((1, 1), (200, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            out = py.score(df.repartition(parts), burn=2, samples=2, bucket_bytes=4000)
            seen.add(tuple(sorted((r.doc_id, r.score) for r in out.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_order_of_words_counts(spark):
    """A word that always comes next is far likelier than one as frequent that never does."""
    rows = [(i, f"alpha beta x{i} gamma delta y{i} beta gamma" if i % 2 else f"alpha beta z{i} gamma delta", False) for i in range(60)]
    rows += [(900, "alpha beta gamma delta", True), (901, "alpha delta gamma beta", True)]
    out = {r.doc_id: r.score for r in py.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), burn=3, samples=2).collect()}
    assert out[900] > out[901] + 1


def test_edges(spark):
    rows = [(1, None, False), (2, "", True), (None, "a b", False), (3, "word " * 5000, False), (3, "new words", True), (3, "new words", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("bucket", F.lit(1)).withColumn("kind", F.lit(0)).withColumn("src", F.lit(None).cast("long"))
    out = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in py.score(df, burn=1, samples=1).collect())
    assert out == [("1", 1, 1, 5005), ("2", 1, 1, 5005), ("3", 3, 1, 5005), ("3", 3, 1, 5005), ("3", 5001, 5001, 5005), ("None", 3, 3, 5005)]
    out = py.score(df.withColumn("held_out", F.lit(True)), burn=1, samples=1).collect()
    assert len(out) == 6 and all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in out)
    assert py.score(df.where("false"), burn=1, samples=1).collect() == []
