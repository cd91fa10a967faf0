"""Benchmark decontamination (operator 3), in DataFrame functions only.

A short item hides in a long document if most of its five-word shingles are there, so containment in the item
counts, not similarity. Items are partitioned by size, the number n of their distinct shingles: those of one partition have the same
k = n - ceil(t n) + 1, and each is sketched by its k smallest hashes (bottom-k MinHash). A document that holds at least t n
of an item's shingles misses at most k - 1 of them, so it holds one of any k: the search has no false negatives, and k, a fifth of the
shingles or so, is as small as that allows for the size.

The hashes of a document's shingles, made without their strings in one scan, look up the sketches. A document without such a hit goes no
further. The candidates' documents are read again, and the exact containment counted: words are compared as they are, repeats don't count.

The sketches are broadcast while their measured size allows it; beyond, the join shuffles the hashes.

Defined results: words are as in the other shingle operators (A-Z lower-cased, split at white space); an item with
fewer words than a shingle is one shingle of all its words, found where those words stand at the start, end or
middle of a document; an item or document without words matches nothing; rows that share an item_id or doc_id count
as one item or document, and repeated rows as one; null ids take no part; very long texts are treated whole; empty tables give no rows; columns other than those named
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import BROADCAST_BYTES, broadcast_if_small, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; empty for a null."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.when(text != "", F.split(low, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _starts(width: Column | int) -> Column:
    """Where the shingles of w begin, from 0; none if it has fewer words."""
    return F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width)).otherwise(F.array().cast("array<int>"))


def _hash(width: int):
    """The hash of a shingle of w, from its words."""
    return lambda i: F.xxhash64(F.lit(width), *(F.get("w", i + j) for j in range(width)))


def _string(width: int):
    return lambda i: F.array_join(F.slice("w", i + 1, width), " ")


def _shingles(rows: DataFrame, widths: list[int], *more: str) -> DataFrame:
    """(more, h, words): hashes and words of all shingles of w."""

    def both(width: int):
        return lambda i: F.struct(_hash(width)(i).alias("h"), _string(width)(i).alias("words"))

    each = [F.transform(_starts(k), both(k)) for k in widths]
    return rows.select(*more, F.explode(F.concat(*each)).alias("s")).select(*more, "s.h", "s.words")


def _needed(size: Column, threshold: float) -> Column:
    return F.ceil(F.round(size * threshold, 6))


def item_shingles(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(item_id, width, words, h, size, part, in_sketch): each item's distinct shingles; width is n or, for fewer words, theirs;
    part numbers the partition by size, and is the k of its sketches."""
    w = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    s = None
    for k in range(1, n + 1):
        some = _shingles(w.where(F.size("w") == k if k < n else F.size("w") >= n), [k], "item_id").withColumn("width", F.lit(k))
        s = some if s is None else s.unionByName(some)
    s = s.groupBy("item_id", "words").agg(F.max("width").alias("width"), F.max("h").alias("h"))
    by_item = Window.partitionBy("item_id")
    s = s.withColumn("size", F.count("*").over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("h", "words")))
    s = s.withColumn("part", F.col("size") - _needed(F.col("size"), threshold) + 1)
    return s.select("item_id", "width", "words", "h", "size", "part", (F.col("rank") <= F.col("part")).alias("in_sketch"))


def candidates(docs: DataFrame, s: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, item_id): documents that hold a sketch value of the item. docs: (doc_id, w), s: item_shingles, materialised."""
    sketch = s.where("in_sketch").select("h", "item_id")
    sketch = F.broadcast(sketch) if (sketch.count() * 48) <= BROADCAST_BYTES else sketch
    hashes = F.concat(*(F.transform(_starts(k), _hash(k)) for k in widths))
    return docs.select("doc_id", F.explode(hashes).alias("h")).join(sketch, "h").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): the pairs whose document holds at least `threshold` of the
    item's distinct word shingles."""
    s = materialise(item_shingles(items, n, threshold), "item-shingles")
    widths = sorted(r[0] for r in s.select("width").distinct().collect()) or [n]  # n numbers at most
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    pairs = materialise(candidates(docs.select("doc_id", words(F.col("text")).alias("w")), s, widths), "candidates")
    found = broadcast_if_small(pairs.select(F.col("doc_id").alias("_found")).distinct(), 16)
    again = docs.join(found, F.col("doc_id") == F.col("_found"), "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    want = pairs.join(s.select("item_id", "h", "words", "size"), "item_id")
    held = want.join(_shingles(again, widths, "doc_id"), ["doc_id", "h", "words"]).groupBy("doc_id", "item_id", "words").agg(F.max("size").alias("size"))
    held = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("size").alias("n_shingles"))
    enough = F.col("n_shared") >= _needed(F.col("n_shingles"), threshold)
    return held.where(enough).select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
it AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM iw, range(1, len(w) - least(len(w), 5) + 2) t(i) WHERE len(w) > 0),
ic AS (SELECT item_id, count(*) AS n FROM it GROUP BY item_id),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, k AS width, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, (SELECT DISTINCT width AS k FROM it), range(1, len(w) - k + 2) t(i) WHERE len(w) >= k)
SELECT doc_id, it.item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n) AS BIGINT) AS n_shingles, count(*) / any_value(n) AS containment
FROM ds JOIN it ON ds.s = it.s AND ds.width = it.width JOIN ic ON ic.item_id = it.item_id GROUP BY doc_id, it.item_id HAVING count(*) >= ceil(round(any_value(n) * 0.8, 6))
"""
