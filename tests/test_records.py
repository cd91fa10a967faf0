from pyspark.sql import functions as F

from strataspan.functions import units
from strataspan.operators import records


def test_rates(spark):
    rows = [(1, 0, 0), (1, 100_000, 10), (1, 600_000, 60), (2, 0, 5), (2, 700_000, 12)]
    df = records.rates(spark.createDataFrame(rows, "k int, t long, d long"), ["k"], "t", "d")
    assert [(r.k, r.t, r.rate) for r in df.orderBy("k", "t").collect()] == [(1, 0, None), (1, 100_000, None), (1, 600_000, 100.0), (2, 0, None), (2, 700_000, 10.0)]


def test_overview(spark):
    for n in (3, 4, 30, 48, 131):
        values = [float(i % 7) for i in range(n)]
        df = records.overview(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double"), ["k"], ["i"], "v")
        want = {}
        for b in range(48 if n >= 4 else 0):
            s = b * n // 48
            part = values[s : min(max((b + 1) * n // 48, s + 1), n)]
            want[b] = sum(part) / len(part)
        assert {r.bar: round(r["mean"], 9) for r in df.collect()} == {b: round(v, 9) for b, v in want.items()}


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("/media/stick/a/b",), ("/media/sticky/a",), ("/",), ("rel/x",)], "p string")
    mounts = spark.createDataFrame([("/", "sda"), ("/media/stick", "sdb"), ("/media", "sdc")], "m string, d string")
    out = {r.p: r.d for r in records.longest_prefix(paths, "p", mounts, "m").collect()}
    assert out == {"/media/stick/a/b": "sdb", "/media/sticky/a": "sdc", "/": "sda", "rel/x": None}


def test_override_recheck_mismatch(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "z")], "k int, v string")
    assert {r.k: r.v for r in records.override(a, b, ["k"], ["v"]).collect()} == {1: None, 2: None, 3: "z"}
    assert {r.k: r.state for r in records.recheck(a, b, "k", ["v"]).collect()} == {1: "changed", 2: "gone", 3: "same"}
    assert {r.k for r in records.mismatches(a, b, ["k"], ["v"]).collect()} == {1, 2}


def test_latest_and_neighbours(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 9, False), (1, 7, True), (2, 1, False)], "k int, seq int, ok boolean")
    assert [(r.k, r.seq) for r in records.latest_valid(df, ["k"], ["seq"], F.col("ok")).collect()] == [(1, 7)]
    n = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, v string")
    assert [r.i for r in records.drop_neighbours(n, ["k"], "i", "v").orderBy("i").collect()] == [0, 2, 4, 5]


def test_prefix_sum(spark):
    rows = [(i % 2, i, i * 3) for i in range(50)]
    df = records.prefix_sum(spark.createDataFrame(rows, "k int, i int, n long"), ["k"], "i", "n", 7)
    for r in df.collect():
        assert r.offset == sum(n for k, i, n in rows if k == r.k and i < r.i)


def test_units(spark):
    golden = {0: "0 B", 999: "999 B", 1000: "1.00 kB", 1025: "1.02 kB", 999_999: "1.00 MB", 31_914_983_424: "31.9 GB", 999_499_999: "999 MB", 10**15: "1.00 PB"}
    assert {n: units.bytes_text(n) for n in golden} == golden
    out = spark.createDataFrame([(n,) for n in golden], "n long").select("n", units.human_bytes("n").alias("t")).collect()
    assert {r.n: r.t for r in out} == golden
    times = {0.0: "0s", 0.3: "<1s", 0.5: "1s", 42.4: "42s", 78.0: "1m 18s", 3599.6: "1h 00m", 3900.0: "1h 05m", -3.0: "0s"}
    assert {s: units.duration_text(s) for s in times} == times
    out = spark.createDataFrame([(s,) for s in times], "s double").select("s", units.human_duration(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in out} == times
    sizes = {"4M": 4 << 20, "512K": 512 << 10, "1k": 1024, "2TiB": 2 << 40, "7": 7, "": None, "4MB": None, "-1": None, "99999999999999999999": None, "9999999999T": None}
    out = spark.createDataFrame([(s,) for s in sizes], "s string").select("s", units.parse_size(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in out} == sizes


def test_loose_json(spark):
    from strataspan.functions import loose_json as j

    cases = {'{"k": 1}': (1, True, None), '{"k": "1"}': (1, True, "1"), '{"k": true}': (0, True, None), '{"k": " x "}': (0, False, "x"), '{"k": null}': (0, False, None), "{}": (0, False, None), '{"k": "True"}': (0, True, "True"), '{"k": 70}': (70, False, None)}
    v = F.try_parse_json("t")
    out = spark.createDataFrame([(c,) for c in cases], "t string").select("t", j.number(v, "k").alias("n"), j.flag(v, "k").alias("f"), j.text(v, "k").alias("s")).collect()
    assert {r.t: (r.n, r.f, r.s) for r in out} == cases
