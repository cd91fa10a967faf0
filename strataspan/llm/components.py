"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    """Number of links, a sum of their hashes, and the most links that a node has."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").cast("decimal(38,0)").alias("h"))
    each = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    ends, total, most = each.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (ends or 0) // 2, total, most or 0


#: A node with more neighbours than this, or than a MOST_HEAVY-th of all links, is heavy: at most MOST_HEAVY nodes are.
HEAVY, MOST_HEAVY = 1024, 1_000_000


def _least(pairs: DataFrame, own: bool) -> DataFrame:
    """(a, m, degree): the smallest neighbour of each a (or a itself, if `own`), combined on the map side."""
    m = F.min("b")
    return pairs.groupBy("a").agg((F.least(m, F.first("a")) if own else m).alias("m"), F.count("*").alias("degree"))


def _beside_least(pairs: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """pairs (a, b) with the m of their a. If some a have over `heavy` rows (0: none has), neighbours of these few nodes stay where they are and the nodes are broadcast."""
    if not heavy:
        return pairs.join(least.select("a", "m"), "a").select("a", "b", "m")
    hot = F.broadcast(least.where(F.col("degree") > heavy).select("a", "m"))
    rest = pairs.join(hot.select(F.col("a").alias("_hot")), F.col("a") == F.col("_hot"), "left_anti")
    return pairs.join(hot, "a").select("a", "b", "m").unionByName(rest.join(least.where(F.col("degree") <= heavy).select("a", "m"), "a").select("a", "b", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node that can be reached.

    Each round is written to the shared folder, so lineage stays short. Minima combine on the map side, and the
    neighbours of a node with very many are not brought to one task. Loops and repeated links change nothing; no
    links give no rows; a link with a null end is left out."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heavy = max(HEAVY, 2 * state[0] // MOST_HEAVY)
        heavy = heavy if state[2] > heavy else 0  # the large star gives no node more links than it has
        large = _beside_least(both.where("b > a"), _least(both, True), heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _beside_least(large, _least(large, False), heavy).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, edges = edges, materialise(small.where("a <> b").distinct(), "edges")
        discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    heads = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(heads)
