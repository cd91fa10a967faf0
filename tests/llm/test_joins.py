"""N-gram join, decontamination and top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.llm import components, decontam, ngram_join, queries, shingles, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingle_set(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    ids, sets = [d for d, _ in rows], [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, groups=25):
    r = random.Random(seed)
    rows, d = [], 0
    passage = [f"p{i}" for i in range(40)]
    for _ in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 2, 4, 12, 30, 80, 300]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, len(w) // 30, len(w) // 10])):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            if r.random() < 0.2:
                w += passage
            rows.append((d, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
            d += r.randint(1, 3)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80), (5, 50)])
def test_components(spark, n, num):
    rows = corpus(n * num) + [(10_000, None), (10_001, ""), (10_002, " \n "), (10_003, "one"), (10_004, "One"), (10_005, "Ünï one"), (10_006, "ünï one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "2 as rep", "3 as cluster")
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_classes(df, n, num, 100).collect())
    assert out == brute(rows, n, num, 100)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    rows = corpus(4, 20)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 500)
    monkeypatch.setattr(ngram_join, "BUCKET", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_classes(df, 3, 70, 100).collect())
    assert out == brute(rows, 3, 70, 100)


def test_large_bucket(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(r.choice([1, 3, 6])):
            w[r.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.similar_classes(df, 3, 90, 100).collect())
    assert out == brute(rows, 3, 90, 100)


def test_repeats_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    out = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert ngram_join.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """A near copy of the smaller text of a doc_id is linked; so are the near copies of each through the doc_id."""
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    small, large = text("s", 100), text("l", 400)
    rows = [(9, small), (9, large), (9, ""), (5, small + " x"), (7, large + " x"), (8, text("o", 50)), (9, small), (None, small)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.similar_classes(df, 3, 90, 100).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 98, 0), (5, 99, 5), (7, 399, 5), (8, 48, 8), (9, 0, 9), (9, 98, 5), (9, 98, 5), (9, 398, 5)]


def test_tree_links_against_all_pairs():
    r = np.random.Generator(np.random.PCG64(5))
    for num in (50, 80, 90):
        sets = []
        for _ in range(40):
            base = np.unique(r.integers(0, 2**63, r.integers(1, 90)).astype(np.uint64))
            for _ in range(r.integers(1, 5)):
                s = base[r.random(len(base)) > r.choice([0, 0.03, 0.1])]
                sets.append(np.unique(np.append(s, r.integers(0, 2**63, 1 + len(base) // 30).astype(np.uint64))))
        cut = len(sets) // 3
        for left, right in ((sets, None), (sets[:cut], sets[cut:])):
            links = ngram_join.tree_links(left, right, num, 100)
            everything, comp = left + (right or []), list(range(len(sets)))

            def group(edges):
                p = list(range(len(everything)))
                for a, b in edges:
                    ra, rb = p[a], p[b]
                    p = [ra if x == rb else x for x in p]
                return {frozenset(i for i in range(len(p)) if p[i] == c) for c in set(p)}

            ok = lambda a, b: 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))
            pairs = [(i, j) for i in comp for j in comp if i < j and (right is None or i < cut <= j) and ok(everything[i], everything[j])]
            assert group(links) == group(pairs) and len(links) < len(everything)


def test_segments_meet():
    """Linked sets share a bucket, whatever their sizes."""
    r = np.random.Generator(np.random.PCG64(8))
    for num in (80, 90):
        for _ in range(300):
            a = np.unique(r.integers(0, 2**64, r.integers(1, 400), dtype=np.uint64))
            d = 2 * len(a) * (100 - num) // (100 + num)
            drop = r.integers(0, d + 1)
            b = np.unique(np.append(r.permutation(a)[drop:], r.integers(0, 2**64, r.integers(0, d - drop + 1), dtype=np.uint64)))
            if len(b) and not np.array_equal(a, b) and 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                assert len(np.intersect1d(ngram_join.signatures(a, num, 100), ngram_join.signatures(b, num, 100)))


def test_shingle_hashes():
    texts = ["a b c d", "A B C D", None, "", "a b", "x" * 100_000, " a\tb\nc\x0bd "]
    got = list(shingles.shingle_sets(texts, 3))
    assert [len(g) for g in got] == [2, 2, 0, 0, 1, 1, 2] and np.array_equal(got[0], got[1]) and np.array_equal(got[0], got[6])
    long = " ".join(f"w{i}" for i in range(5000))
    assert len(next(iter(shingles.shingle_sets([long], 5)))) == 4996


def test_components_of_heavy_nodes(spark):
    hubs = [(5000, k) for k in range(1, 3000)] + [(k, 9000) for k in range(4000, 7000)] + [(9000, 9001), (9001, 9001), (9001, 9000), (2999, 8000), (None, 3), (3, None)]
    df = spark.createDataFrame(hubs, "a long, b long")
    out = {r.node: r.component for r in components.connected_components(df).collect()}
    assert set(out.values()) == {1} and set(out) == {*range(1, 3000), *range(4000, 7000), 8000, 9000, 9001}
    least = components._least(df.where("a is not null and b is not null"), False)
    assert components._beside_least(df.where("b < a"), least, 1024).count() == df.where("b < a").count()


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: c for n, c in out.items() if n < 100} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert {out[n] for n in range(100, 141)} == {100} and {out[n] for n in range(500, 551)} == {500}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op3_decontaminate", "op8_topk_search"])
def test_queries(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_decontamination(spark):
    r = random.Random(2)
    item = [f"w{i}" for i in range(30)]
    docs = [(1, "lead in " + " ".join(item).upper() + " tail"), (2, " ".join(item[:15])), (3, " ".join(item[:26])), (4, "short words"), (5, None), (6, ""), (None, " ".join(item)), (7, "say short words twice"), (7, "say short words twice"), (8, " ".join(f"z{r.random()}" for _ in range(2000)) + " " + " ".join(item))]
    items = [(1, " ".join(item)), (2, "short\twords"), (3, None), (4, ""), (None, "say short words twice")]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("size", F.lit(2)), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((x.doc_id, x.item_id, x.n_shared, x.n_shingles) for x in out.collect())
    assert got == [(1, 1, 26, 26), (3, 1, 22, 26), (4, 2, 1, 1), (7, 2, 1, 1), (8, 1, 26, 26)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
    twice = spark.createDataFrame(items + items[:2] + [(1, "another text of the same item")], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame([], "doc_id long, text string"), twice).count() == 0
    got = sorted((x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items * 2, "item_id long, text string")).collect())
    assert got == [(1, 1), (3, 1), (4, 2), (7, 2), (8, 1)]


def test_only_sketch_hits_are_verified(spark):
    """Documents that hold many shingles of an item but none of its sketch are no candidates, and any that holds enough is one."""
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 60)))) for i in range(40)]
    s = decontam.item_shingles(spark.createDataFrame(items, "item_id long, text string"), 5, 0.8)
    rows = s.collect()
    size = {x.item_id: x.size for x in rows}
    sketch = {i: {x.words for x in rows if x.item_id == i and x.in_sketch} for i in size}
    assert all(len(sketch[i]) == size[i] - math.ceil(round(0.8 * size[i], 6)) + 1 == {x.part for x in rows if x.item_id == i}.pop() for i in size)
    assert sum(map(len, sketch.values())) < 0.35 * len(rows)
    docs = [(i * 100 + k, " ".join(t.split()[k : k + n])) for i, t in items for k, n in ((0, 60), (1, 60), (3, 12), (0, 6), (9, 40))]
    found = {(x.doc_id, x.item_id) for x in decontam.candidates(spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", decontam.words(F.col("text")).alias("w")), s, [5]).collect()}
    shingles = lambda t: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    assert found == {(d, i) for d, t in docs for i in size if shingles(t) & sketch[i]}
    held = {(d, i) for d, t in docs for i, x in items if len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x))}
    assert held <= found and len(found) < len({(d, i) for d, t in docs for i, x in items if shingles(t) & shingles(x)})


def test_decontamination_is_native(spark, sf):
    plan = decontam.op3_decontaminate(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_blocks_are_skipped(spark):
    """Where vectors have some structure, bounds fall below the k-th score; results stay exact, with a floor from elsewhere too."""
    r = np.random.Generator(np.random.PCG64(1))
    x = np.floor(256 * (r.normal(size=(40, 32))[r.integers(0, 40, 4000)] + 0.15 * r.normal(size=(4000, 32)))).astype(np.int64)
    ids = np.arange(len(x)) * 3
    q, q_ids = x[::50], ids[::50]
    s = np.where(q_ids[:, None] == ids, -(2**62), q @ x.T)
    best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
    blocks = topk.blocks_of(ids, x, 128)
    assert np.array_equal(np.sort(np.concatenate(blocks)), np.arange(len(x))) and max(map(len, blocks)) <= 128
    bound = topk.bounds_of(q, x, blocks)
    assert all((bound[:, k] >= (q @ x[b].T).max(axis=1)).all() for k, b in enumerate(blocks))
    for floor in (None, np.take_along_axis(s, best[:, 4:], 1)[:, 0]):
        who, found, score, (pairs, scored) = topk.search_block(q_ids, q, ids, x, 5, 128, floor)
        assert np.array_equal(found.reshape(-1, 5), ids[best]) and scored < 0.2 * pairs
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids[:1200], x[:1200], strict=True)], "vec_id long, embedding array<double>")
    pairs, scored = topk.pruning(topk.quantise(df, scale=1), F.col("vec_id") % 50 == 0, group=300, block=32)
    assert 0 < scored < 0.5 * pairs
    with pytest.raises(OverflowError):
        topk.search_block(q_ids, q * 2**40, ids, x * 2**20, 5, 128)


def test_topk(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 1)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0]), (350, rows[0][1]), (351, rows[0][1]), (352, [1.0, 2.0]), (400, [])]
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: int(np.dot(a[: min(len(a), len(b))], b[: min(len(a), len(b))]))
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted((-dot(q[i], q[j]), j) for j in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    df = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)))
    out = topk.topk_search(df, F.col("vec_id") % 50 == 0, 5, group=64, queries=3, block=16)
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    again = df.unionByName(df.where("vec_id in (50, 3, 351)"))
    out = topk.topk_search(again, F.col("vec_id") % 50 == 0, 5, group=64, queries=3, block=16)
    assert out.where("query_id = 100").count() == 5 and out.where("query_id <> 50").groupBy("query_id", "rank").count().where("count > 1").isEmpty()
    two = topk.topk_search(df.where("vec_id in (0, 7)"), F.col("vec_id") % 50 == 0)
    assert [(x.query_id, x.vec_id) for x in two.collect()] == [(0, 7)]
    assert topk.topk_search(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
