"""Exact top-k search by inner product (operator 8): block-at-a-time pruning.

The candidates are dealt out in ranges of vec_id. Within a range, vectors that lie near the same of a few of its vectors are put together and cut into blocks. Each block
has the largest and the smallest value of every dimension; for a query they bound the score of any vector in the
block: the sum over dimensions of the larger of q times max and q times min. Its centre and the largest distances from it, by pieces of
the dimensions, bound it as well, and the smaller bound holds. Blocks are taken in order of their bounds and scored
through their forward index (the block's matrix) until the next bound falls below the query's k-th score. That score is a shared one: a first pass
searches the first range alone, and the other ranges begin with the k-th score that it found. Queries
and ranges meet in blocks of bounded size, so a task holds one block of queries and one range of candidates; the best of each pair
of blocks are then ranked together. Every range is sent to every block of queries: candidates times ceil(queries / `queries`) rows in all.

How much is skipped depends on the data: `pruning` counts it. Vectors without any structure have bounds above every score, and nothing is skipped.

Arithmetic is in integers; it runs through float64 products only where every partial sum is proven below 2^53. Scores must fit 64 bits: a range
whose components could exceed them raises an error.

Defined results: components are floor(scale * x); vectors that are null or hold a null or non-finite component take
no part; a missing component (vectors of differing length) counts as 0; ties go to the smaller vec_id; rows with the query's own
vec_id are not candidates; repeated rows are candidates, and queries, each; a query with no candidates has no rows; null vec_ids take no part; an empty table has no rows;
columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import discard, materialise, table

RANKED = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def blocks_of(ids: np.ndarray, x: np.ndarray, block: int) -> list[np.ndarray]:
    """The rows of x in blocks of `block` at most, near ones together."""
    if len(ids) <= block:
        return [np.arange(len(ids))]
    f = x.astype(np.float64)
    f /= np.maximum(np.sqrt((f * f).sum(axis=1, keepdims=True)), 1e-9)
    heads = f[np.linspace(0, len(f) - 1, max(2, 2 * len(f) // block)).astype(np.int64)]
    near = np.concatenate([np.argmax(f[a : a + 4096] @ heads.T, axis=1) for a in range(0, len(f), 4096)])
    order = np.lexsort((ids, near))
    cuts = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
    return [part[a : a + block] for part in np.split(order, cuts[1:]) for a in range(0, len(part), block)]


def bounds_of(q: np.ndarray, x: np.ndarray, blocks: list[np.ndarray], pieces: int = 8) -> np.ndarray:
    """For each query and block a number that no score of the block exceeds."""
    top, low = (np.array([f(x[b], axis=0) for b in blocks], dtype=np.float64) for f in (np.max, np.min))
    q = q.astype(np.float64)
    box = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    centre = np.array([x[b].mean(axis=0) for b in blocks])
    ball = q @ centre.T
    for part in np.array_split(np.arange(q.shape[1]), min(pieces, max(1, q.shape[1]))):
        far = np.array([np.sqrt((((x[b][:, part] - c[part]) ** 2).sum(axis=1)).max(initial=0)) for b, c in zip(blocks, centre, strict=True)])
        ball += np.sqrt((q[:, part] ** 2).sum(axis=1))[:, None] * far
    bound = np.minimum(box, ball)
    return bound + 1e-9 * np.abs(q).sum(axis=1)[:, None] * max(1.0, float(np.abs(x).max(initial=0))) + 0.5  # rounding


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """The k best of x for every query: (query index, candidate id, score), and how many pairs of a query and a block there are and were
    scored. floor: a score for each query (or the least integer) that k candidates elsewhere reach; what is below may be left out."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if largest >= 2**63:
        raise OverflowError("scores of more than 64 bits")
    kind = np.float64 if largest < 2**53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    blocks = blocks_of(ids, x, block)
    bound = bounds_of(q, x, blocks)
    order = np.argsort(-bound, axis=1, kind="stable")
    nothing = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    best_s = np.full((len(q), k), nothing, dtype=kind)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
    least = np.full(len(q), -np.inf) if floor is None else np.where(floor == np.iinfo(np.int64).min, -np.inf, floor.astype(np.float64))
    active, scored = np.arange(len(q)), 0
    for step in range(len(blocks)):
        kth = np.where(best_i[active, k - 1] == np.iinfo(np.int64).max, -np.inf, best_s[active, k - 1].astype(np.float64))
        active = active[bound[active, order[active, step]] >= np.maximum(kth, least[active])]
        if not len(active):
            break
        scored += len(active)
        taken = order[active, step]
        for b in np.unique(taken):
            mine, rows = active[taken == b], blocks[b]
            s = q[mine] @ x[rows].T
            here = np.broadcast_to(ids[rows], s.shape)
            own = here == q_ids[mine][:, None]
            s = np.concatenate([best_s[mine], np.where(own, nothing, s)], axis=1)
            i = np.concatenate([best_i[mine], np.where(own, np.iinfo(np.int64).max, here)], axis=1)
            pick = np.lexsort((i, np.where(s == nothing, np.iinfo(np.int64).max if kind is np.int64 else np.inf, -s)), axis=1)[:, :k]
            best_s[mine], best_i[mine] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    who, at = np.nonzero(best_i != np.iinfo(np.int64).max)
    return who, best_i[who, at], best_s[who, at].astype(np.int64), (len(q) * len(blocks), scored)


def _found(vectors: DataFrame, is_query, k: int, group: int, queries: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) of the best in each range; for each task a row with query_id null, the pairs of a query and a block, and those scored."""
    vectors = materialise(vectors, "vectors")

    def dealt(rows: DataFrame, each: int, name: str) -> tuple[DataFrame, int]:
        """The rows in ranges of vec_id with about `each` rows, numbered in `name`; and how many numbers there are."""
        parts = -(-rows.count() // each) or 1
        rows = materialise(rows.repartitionByRange(parts, "vec_id").withColumn(name, F.spark_partition_id()), name)
        return rows, (rows.agg(F.max(name)).first()[0] or 0) + 1

    left, n_groups = dealt(vectors, group, "_part")
    right, n_asked = dealt(vectors.where(is_query), queries, "_ask")
    discard(vectors)
    none = np.iinfo(np.int64).min

    def search(key, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("Int64")
        x = x.sort_values("vec_id")
        dim = max(x["v"].map(len).max(), q["v"].map(len).max())
        ids, floor = q["vec_id"].to_numpy(), q["_floor"].to_numpy()
        who, found, score, (pairs, scored) = search_block(ids, _matrix(q["v"], dim), x["vec_id"].to_numpy(), _matrix(x["v"], dim), k, block, floor)
        out = pd.DataFrame({"query_id": ids[who], "vec_id": found, "score": score}).astype("Int64")
        return pd.concat([out, pd.DataFrame({"query_id": [None], "vec_id": [pairs], "score": [scored]}).astype("Int64")])

    def meet(some: DataFrame, asked: DataFrame, groups: range) -> DataFrame:
        some = some.withColumn("_ask", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(groups.start), F.lit(groups.stop - 1))))
        return some.groupBy("_part", "_ask").cogroup(asked.groupBy("_part", "_ask")).applyInPandas(search, RANKED)

    first = meet(left.where("_part = 0"), right.withColumn("_floor", F.lit(none)), range(1))
    if n_groups == 1:
        return first
    first = materialise(first, "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # repeated queries share an id and find the same: their k-th score is that of k rows of one of them at least, as all have equal scores
    kth = first.where("query_id is not null").distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_floor"))
    asked = right.join(kth, right["vec_id"] == kth["_q"], "left").select(*right.columns, F.coalesce("_floor", F.lit(none)).alias("_floor"))
    return first.unionByName(meet(left.where("_part > 0"), asked, range(1, n_groups)))


def topk_search(vectors: DataFrame, is_query, k: int = 5, group: int = 8192, queries: int = 4096, block: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score) over quantised vectors (vec_id, v). is_query: a condition on vec_id."""
    found = _found(vectors, is_query, k, group, queries, block).where("query_id is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, is_query, k: int = 5, group: int = 8192, queries: int = 4096, block: int = 128) -> tuple[int, int]:
    """(pairs of a query and a block, those of them that were scored): the rest was skipped."""
    row = _found(vectors, is_query, k, group, queries, block).where("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()
    return row[0] or 0, row[1] or 0


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    return topk_search(quantise(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
