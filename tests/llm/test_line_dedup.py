import hashlib
import random

import pytest

from strataspan.llm import line_dedup, queries

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    """{(doc_id, text): kept text}, by a dictionary of lines."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                k = line.strip(WHITE).translate(low)
                first[k] = min(first.get(k, d), d)
    keep = lambda d, line: d is None or len(k := line.strip(WHITE).translate(low)) < least or d <= first[k]
    return sorted(("\n".join(x for x in (t or "").split("\n") if keep(d, x)), str(d)) for d, t in rows)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' as h", "1 as pos", "2 as keep")
    out = line_dedup.line_dedup(df, **more)
    assert out.columns == df.columns
    return sorted((r.text or "", str(r.doc_id)) for r in out.collect())


def test_random(spark):
    r = random.Random(3)
    lines = [f"a common line number {i}" for i in range(8)] + ["short", "", "  A Common Line Number 3\t", "Été À LA ligne", "été à la ligne", "ÉTÉ À LA LIGNE"]
    rows = [(r.randrange(60), "\n".join(r.choice(lines + [f"unique {r.random()}"]) for _ in range(r.randint(0, 9)))) for _ in range(120)]
    assert run(spark, rows) == brute(rows)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"the very same line everywhere\nown line of document {i}") for i in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (None, "a line that is long enough"), (7, "a line that is long enough\nA LINE that is long enough"), (8, " a line that is long enough "), (8, " a line that is long enough "), (9, "x" * 200_000 + "\n" + "x" * 200_000), (10, "x" * 200_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_bitmaps_instead_of_text(spark):
    df = spark.createDataFrame([(1, "first long line\nsecond long line"), (2, "second long line\nthird long line\nfirst long line")], "doc_id long, text string")
    (b,) = line_dedup.keep_bitmaps(df).collect()
    assert (b.doc_id, b.n_lines, b.n_dropped) == (2, 3, 2) and line_dedup.kept_lines("a\nb\nc", bytes(b.keep)) == (["b"], 3)


def test_query(same, spark, sf):
    same(queries.QUERIES["op4_line_dedup"], queries.ORACLES["op4_line_dedup"])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {int(d): hashlib.sha256(t.encode()).hexdigest() for t, d in brute(docs)}
    assert {r.doc_id: r.kept_sha256 for r in line_dedup.op4_line_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("name", ["h", "pos", "keep", "_keep", "_doc", "n_lines"])
def test_column_names_that_clash(spark, name):
    df = spark.createDataFrame([(1, "a line of some length", 1)], f"doc_id long, text string, {name} int")
    assert line_dedup.line_dedup(df).count() == 1
