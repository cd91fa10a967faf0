import random

import pytest

from strataspan.formats import bits, layout
from strataspan.operators import extents


def frame(spark, rows, names="k long, start long, end long"):
    return spark.createDataFrame(rows, names)


def got(df):
    return sorted((r.start, r.end) for r in df.collect())


def ranges(seed, n=300, most=1 << 20):
    r = random.Random(seed)
    return [(s, s + r.choice([0, 1, 7, 500, 4096, 20_000])) for s in (r.randrange(most) for _ in range(n))]


@pytest.mark.parametrize("gap", [0, 1, 4096, 65_536])
@pytest.mark.parametrize("width", [None, 1 << 14])
def test_merge(spark, gap, width):
    rows = ranges(gap + 1)
    df = frame(spark, [(1, s, e) for s, e in rows])
    assert got(extents.merge_gap(df, ["k"], gap, width)) == bits.merge(rows, gap)


def test_gap_is_strict_and_touching_joins(spark):
    df = frame(spark, [(1, 0, 10), (1, 10, 20), (1, 25, 30), (1, 36, 40)])
    assert got(extents.merge_gap(df, ["k"], 5)) == [(0, 20), (25, 30), (36, 40)]
    assert got(extents.merge_gap(df, ["k"], 6)) == [(0, 30), (36, 40)]


@pytest.mark.parametrize("limit", [1, 5, 40, 100_000])
@pytest.mark.parametrize("align", [1, 4096])
def test_normalize(spark, limit, align):
    rows = ranges(limit + align, 200, 1 << 24)
    df = frame(spark, [(1, s, e) for s, e in rows])
    assert got(extents.normalize(df, ["k"], 1 << 24, 4096, align, limit)) == layout.normalize(rows, 1 << 24, 4096, align, limit)


def test_normalize_case(spark):
    df = frame(spark, [(1, 10000, 10100), (1, 0, 1), (1, 5000, 5010), (1, 200000, 200001), (1, 2**62, 2**62 + 5)])
    assert got(extents.normalize(df, ["k"], 300000)) == [(0, 12288), (196608, 200704)]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_limit(spark, most):
    rows = ranges(7, 60, 1 << 26)
    out, gap = bits.merge(rows), layout.GAP
    while len(out) > most:
        gap *= 2
        out = bits.merge(out, gap)
    assert got(extents.limit_extents(frame(spark, [(1, s, e) for s, e in rows]), ["k"], most)) == out


def test_complement(spark):
    rows = ranges(3, 50)
    bounds = spark.createDataFrame([(1, 1000, 900_000), (2, 0, 10)], "k long, low long, high long")
    out = extents.complement(frame(spark, [(1, s, e) for s, e in rows]), ["k"], bounds)
    want = [(max(s, 1000), min(e, 900_000)) for s, e in bits.complement(rows, 900_000) if e > 1000 and s < 900_000]
    assert sorted((r.k, r.start, r.end) for r in out.collect()) == sorted([(1, *w) for w in want] + [(2, 0, 10)])


def test_range_join_counts_each_pair_once(spark):
    a, b = bits.merge(ranges(4, 80)), ranges(5, 80)
    b = [(s, e) for s, e in b if s < e]
    left, right = frame(spark, [(1, *x) for x in a]), frame(spark, [(1, *x) for x in b])
    out = sorted((r.start, r.end, r.r_start, r.r_end) for r in extents.range_join(left, right, ["k"], 3000).collect())
    assert out == sorted((*x, *y) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    free = got(extents.range_join(left, right, ["k"], 3000, "left_anti"))
    assert free == sorted(x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b))


def test_overlap_sum(spark):
    a = bits.merge(ranges(8, 60))
    windows = [(i * 50_000, (i + 1) * 50_000) for i in range(21)]
    df = extents.overlap_sum(frame(spark, [(1, *x) for x in a]), frame(spark, [(1, *w) for w in windows]), ["k"], 10_000)
    assert {(r.start, r.used) for r in df.collect()} == {(s, layout.overlap(a, s, e - s)) for s, e in windows}


def test_overlay_last_wins(spark):
    p = [(1, 0, 100, 1), (1, 50, 80, 2), (1, 60, 70, 3)]
    df = extents.overlay(spark.createDataFrame(p, "k long, start long, end long, ord int"), ["k"], "ord", 16)
    assert sorted((r.start, r.end, r.ord) for r in df.collect()) == [(0, 50, 1), (50, 60, 2), (60, 70, 3), (70, 80, 2), (80, 100, 1)]


def test_remap_and_locate(spark):
    seg = spark.createDataFrame([(1, 0, 100, 5000), (1, 100, 300, 90)], "k long, start long, end long, target long")
    out = extents.remap(frame(spark, [(1, 50, 150)]), seg, ["k"], 64)
    assert got(out) == [(90, 140), (5050, 5100)]
    pts = spark.createDataFrame([(1, 99), (1, 100), (1, 300)], "k long, at long")
    assert sorted((r.at, r.target) for r in extents.locate(pts, seg, ["k"], "at", 64).collect()) == [(99, 5000), (100, 90)]


def test_conflicts_and_not_covered(spark):
    df = frame(spark, [(1, 0, 10), (1, 5, 7), (1, 10, 12), (2, 5, 7)])
    assert got(extents.conflicts(df, ["k"])) == [(5, 7)]
    assert got(extents.not_covered(frame(spark, [(1, 2, 4), (1, 9, 11)]), frame(spark, [(1, 0, 10)]), ["k"], 4)) == [(9, 11)]


def test_pieces(spark):
    from pyspark.sql import functions as F

    from strataspan.formats import smart

    assert got(extents.cut_pieces(frame(spark, [(1, 5, 25)]), 8)) == [(5, 13), (13, 21), (21, 25)]
    sizes = [0, 1, 4095, 4096, 5000, 67_108_864, 200_000_001]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", extents.zero_pieces(F.col("n")).alias("p"))
    assert {r.n: list(r.p) for r in df.collect()} == {n: smart.zero_pieces(n) for n in sizes}


def test_empty(spark):
    none = frame(spark, [])
    assert got(extents.merge_gap(none, ["k"], 5)) == [] and got(extents.normalize(none, ["k"], 100)) == []
