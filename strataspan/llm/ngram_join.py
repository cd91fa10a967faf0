"""N-gram Jaccard join (operator 2): signature trees.

Two sets link when their Jaccard similarity is at least num / den. Equal sets are one class first, whatever the
number of its copies. A tree over all documents would be one task, so its top is spread over the cluster, without
losing a link: sets are banded by size, and in a band whose sets can differ by at most d elements the hash space is
cut into d + 1 + m segments. Linked sets agree in at least m + 1 whole segments, so they meet in the bucket of one
that has two elements or more (a set with more than m weaker ones also goes to the buckets of those). Pairs of a bucket whose sizes and bitmaps
allow a link (in a very large bucket all of its sets) are chained, and what is chained is a cluster. Within a cluster a signature tree is built: a node holds the OR of its members' token bitmaps, the range of their sizes
and the most elements that any of them lost to shared bits. A dual traversal from the root pairs nodes, and prunes a pair when
the largest overlap that the bitmaps and sizes allow is too small for any two members. Pairs of members that are
left are compared exactly, unless they are already linked through others. Clusters too large for a task are cut into blocks
by size band and hash, each pair of neighbouring blocks is traversed by itself, and their links are joined at the end.

Defined results: a text without words has an empty set, is linked with nothing and is its own component; rows
that share a doc_id are one document (links of either join both when the copies differ: each text is searched for under a key of its own); a null doc_id is its own
component, null; repeated rows give repeated results; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import broadcast_if_small, discard, materialise, small, table
from strataspan.llm.components import connected_components
from strataspan.llm.shingles import mix, shingle_sets

#: Members and elements of a block: what a task holds is bounded by a pair of blocks.
BLOCK_SETS, BLOCK_ELEMENTS = 4096, 6_000_000
FAN = 8


@lru_cache(8)
def bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """The largest size of each band. A set's partners are in its own band and the two beside it."""
    out, low = [], 1
    while low < most:
        high = max(low, int(low * 5 // 4), low * den // num)
        out.append(high)
        low = high + 1
    return np.array(out, dtype=np.int64)


def band_of(size: int, num: int, den: int) -> int:
    return int(np.searchsorted(bands(num, den), size))


def segments(high: int, num: int, den: int) -> tuple[int, int]:
    """(number of segments, spare ones m) for sets of at most `high` elements; 0 segments if linked sets must be equal."""
    d = 2 * high * (den - num) // (den + num)
    m = 2 + d * 3 // 20
    return (d + 1 + m, m) if d else (0, 0)


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The buckets that a sorted set goes to: those of its band, and of the next if a partner may be there."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    edges = bands(num, den)
    own = band_of(n, num, den)
    out = []
    for b in (own, own + 1):
        if b > own and n * den < (edges[own] + 1) * num:
            break
        k, m = segments(int(edges[b]), num, den)
        if not k:
            continue
        seg = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascends with h
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        total = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
        place = np.uint64(b << 40) + seg[first]
        sig, full = mix(total + mix(place)), np.diff(np.append(first, n)) >= STRONG
        if k - int(full.sum()) <= m:  # of the m + 1 segments and more that linked sets agree in, one is not weak
            out.append(sig[full])
            continue
        out.append(sig)
        if k - len(first) > m:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), seg[first])
            out.append(mix(mix(np.uint64(b << 40) + empty) + np.uint64(1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Bits of the bitmap that goes with a set while buckets are searched, and members beyond which a bucket is chained whole.
BITS, BUCKET = 1024, 4096
#: A segment with fewer elements is weak: one passage in common is enough to share it.
STRONG = 2
SETS = "doc_id long, n long, k1 long, k2 long, bits binary"


def bitmap(h: np.ndarray) -> bytes:
    """A set's tokens OR-combined into BITS bits."""
    row = np.zeros(BITS, dtype=np.uint8)
    row[(h % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(row).tobytes()


def possible(n: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs may link by their sizes and bitmaps: an element of the overlap has its bit in both, or was lost to a shared bit."""
    out = np.zeros(len(a), dtype=bool)
    lost = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for s in range(0, len(a), 1 << 16):
        x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
        both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(lost[x], lost[y])
        out[s : s + (1 << 16)] = (den + num) * np.minimum(both, np.minimum(n[x], n[y])) >= num * (n[x] + n[y])
    return out


def _bucket_edges(num: int, den: int):
    """Rows (sig, rep, n, bits), a bucket's together: (a, b) for pairs that may link, or a chain of stars that joins the same sets."""

    def pairs(sig: np.ndarray, rep: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        left, right = [], []
        for b in np.unique(size[(size > 1) & (size <= 64)]).tolist():  # all pairs, of all buckets with so many members at once
            i, j = np.triu_indices(b, 1)
            start = first[size == b][:, None]
            x, y = (start + i).ravel(), (start + j).ravel()
            ok = possible(n, bits, x, y, num, den)
            left.append(x[ok])
            right.append(y[ok])
        for start, b in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            here = np.arange(start, start + b)
            if b > BUCKET:
                left.append(here[1:])
                right.append(np.full(b - 1, start))
                continue
            label = np.arange(b)
            for i in range(1, b):  # each member with those before it that it isn't joined to yet
                others = np.flatnonzero(label[:i] != label[i])
                hit = others[possible(n, bits, np.full(len(others), start + i), start + others, num, den)]
                if len(hit):
                    joined = np.unique(np.append(label[hit], label[i]))
                    one, at = np.unique(label[hit], return_index=True)
                    left.append(np.full(len(one), start + i))
                    right.append(start + hit[at])
                    label[np.isin(label, joined)] = joined[0]
        none = [np.zeros(0, np.int64)]
        return rep[np.concatenate(left or none)], rep[np.concatenate(right or none)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def out(rows: tuple) -> pa.RecordBatch:
            a, b = pairs(*rows)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, BITS // 64)
            rows = (*(batch.column(k).to_numpy() for k in range(3)), bits)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            other = np.flatnonzero(rows[0] != rows[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0  # where the bucket begins that may go on
            if len(rows[0]) - last > 4 * BUCKET:  # a bucket that is chained whole: its first member stands for those read
                first = tuple(x[last : last + 1] for x in rows)
                yield pa.record_batch([pa.array(rows[1][last + 1 :]), pa.array(np.full(len(rows[1]) - last - 1, rows[1][last]))], names=["a", "b"])
                rows = tuple(np.concatenate([x[:last], f, np.repeat(f, BUCKET, axis=0)]) for x, f in zip(rows, first, strict=True))
            if last:
                yield out(tuple(x[:last] for x in rows))
            held = tuple(x[last:] for x in rows)
        if held is not None:
            yield out(held)

    return run


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """Each row's set size, a 128-bit key of the set, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bits = [], [], []
            for h in shingle_sets(batch.column(1).to_pylist(), words):
                n.append(len(h))
                keys.append((mix(h + np.uint64(11)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h ^ np.uint64(0x27BB2EE687B0B0FD)))) if len(h) else (np.uint64(0), np.uint64(0)))
                bits.append(bitmap(h))
            keys = np.array(keys, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bits, pa.binary())], names=["doc_id", "n", "k1", "k2", "bits"])

    return docs.mapInArrow(run, SETS)


def _buckets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(rep, sig): the buckets of each row. The sets are made again from the text: their buckets would fill the disk if kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(h, num, den) for h in shingle_sets(batch.column(1).to_pylist(), words)]
            rep = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sigs])
            yield pa.record_batch([pa.array(rep), pa.array(np.concatenate(sigs).view(np.int64) if sigs else rep)], names=["rep", "sig"])

    return docs.mapInArrow(run, "rep long, sig long")


class Tree:
    """Levels of nodes over sets sorted by size; level 0 holds the sets themselves."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
        lost = np.zeros(len(sets), dtype=np.int64)
        row = np.zeros(bits, dtype=np.uint8)
        for i, s in enumerate(sets):
            at = (s % np.uint64(bits)).astype(np.int64)
            row[at] = 1
            maps[i] = np.packbits(row)
            lost[i] = len(s) - int(row.sum())
            row[at] = 0
        self.levels = [(maps.view(np.uint64), n, n, lost)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))


def _may_link(x: Tree, y: Tree, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    xm, xl, xh, xo = x.levels[level]
    ym, yl, yh, yo = y.levels[level]
    near = (den * np.minimum(xh[a], yh[b]) >= num * np.maximum(xl[a], yl[b]))
    a, b = a[near], b[near]
    shared = np.bitwise_count(xm[a] & ym[b]).sum(axis=1, dtype=np.int64)
    most = np.minimum(shared + np.minimum(xo[a], yo[b]), np.minimum(xh[a], yh[b]))
    near[near] = (den + num) * most >= num * (xl[a] + yl[b])
    return near


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right sets, or among left ones if right is None: pairs of
    positions, those of right counted on from left's."""
    everything = left + (right or [])
    if len(everything) < 2:
        return []
    bits = min(1 << 16, max(256, 1 << (4 * int(np.median([len(s) for s in everything]))).bit_length()))
    order_x = sorted(range(len(left)), key=lambda i: (len(left[i]), int(left[i][0])))
    x = Tree([left[i] for i in order_x], bits)
    if right is None:
        y, order_y = x, order_x
    else:
        order_y = sorted(range(len(right)), key=lambda i: (len(right[i]), int(right[i][0])))
        y = Tree([right[i] for i in order_y], bits)
        order_y = [i + len(left) for i in order_y]
    while len(x.levels) != len(y.levels):  # a root above the lower tree's root
        low = x if len(x.levels) < len(y.levels) else y
        low.levels.append(low.levels[-1])
    root = np.arange(len(everything))
    parent = list(range(len(everything)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    ox, oy = np.array(order_x), np.array(order_y)
    chunk = max(256, (8 << 20) // (bits // 8))
    stack = [(len(x.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            stack += [(level, a[s : s + chunk], b[s : s + chunk]) for s in range(0, len(a), chunk)][::-1]
            continue
        if level == 0:
            fresh = root[ox[a]] != root[oy[b]]
            a, b = a[fresh], b[fresh]
        keep = _may_link(x, y, level, a, b, num, den)
        a, b = a[keep], b[keep]
        if level:
            nx, ny = len(x.levels[level - 1][1]), len(y.levels[level - 1][1])
            one = lambda t, count: 1 if len(t.levels[level][1]) == count else FAN
            fx, fy = one(x, nx), one(y, ny)
            ca = (a[:, None] * fx + np.arange(fx))[:, :, None]
            cb = (b[:, None] * fy + np.arange(fy))[:, None, :]
            ca, cb = (v.ravel() for v in np.broadcast_arrays(ca, cb))
            ok = (ca < nx) & (cb < ny)
            if right is None:
                ok &= (ca < cb) if level == 1 else (ca <= cb)
            if ok.any():
                stack.append((level - 1, ca[ok], cb[ok]))
            continue
        for i, j in zip(ox[a].tolist(), oy[b].tolist(), strict=True):
            p, q = find(i), find(j)
            if p == q:
                continue
            s, t = everything[i], everything[j]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = len(t) - 1
            both = int((t[at] == s).sum())
            if den * both >= num * (len(s) + len(t) - both):
                parent[max(p, q)] = min(p, q)
                links.append((i, j))
        if len(links):
            root = np.array([find(i) for i in range(len(parent))])
    return links


def _links(clusters: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is connected, of the members (rep, n, cluster)."""
    edges = [int(e) for e in bands(num, den) if e < 1 << 31]
    band = F.array_position(F.transform(F.array(*map(F.lit, edges)), lambda e: F.col("n") <= e), F.lit(True)).cast("int")
    total = clusters.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    total = total.withColumn("whole", (F.col("sets") <= BLOCK_SETS) & (F.col("elements") <= BLOCK_ELEMENTS))
    size = clusters.join(total.select("cluster", "whole"), "cluster").withColumn("band", F.when(F.col("whole"), 0).otherwise(band))
    parts = size.groupBy("cluster", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    parts = parts.select("cluster", "band", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("parts"))
    whole = lambda d, name: parts.select("cluster", (F.col("band") + d).alias("band"), F.col("parts").alias(name))
    size = size.join(parts, ["cluster", "band"]).join(whole(-1, "above"), ["cluster", "band"], "left").join(whole(1, "below"), ["cluster", "band"], "left")
    p = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    zero = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda bx, px, by, py, side: F.struct(bx.alias("bx"), px.alias("px"), by.alias("by"), py.alias("py"), side.cast("int").alias("side"))
    b = F.col("band")
    own = F.transform(zero(F.col("parts")), lambda q: block(b, F.least(q, F.col("p")), b, F.greatest(q, F.col("p")), F.when(q < F.col("p"), 1).otherwise(0)))
    up = F.transform(zero(F.col("above")), lambda q: block(b, F.col("p"), b + 1, q, F.lit(0)))
    down = F.transform(zero(F.col("below")), lambda q: block(b - 1, q, b, F.col("p"), F.lit(1)))
    size = size.withColumn("p", p)
    size = size.select(F.col("rep").alias("_rep"), "cluster", F.concat(own, F.when(F.col("whole"), F.array().cast("array<struct<bx:int,px:int,by:int,py:int,side:int>>")).otherwise(F.concat(up, down))).alias("blocks"))
    size = materialise(size, "blocks")
    found = docs.join(broadcast_if_small(size, F.size("blocks") * 20 + 24), docs.doc_id == size._rep)
    # texts are dealt out, not sets: they compress, hashes don't
    held = found.withColumn("e", F.explode("blocks")).select("cluster", "e.*", "doc_id", "text")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(rows["text"].tolist(), words))
        sides = [[(d, s) for d, s, side in zip(rows["doc_id"], sets, rows["side"], strict=True) if side == k and len(s)] for k in (0, 1)]
        left, right = ([s for _, s in side] for side in sides)
        same = rows["bx"].iloc[0] == rows["by"].iloc[0] and rows["px"].iloc[0] == rows["py"].iloc[0]
        found = tree_links(left, None, num, den) if same else tree_links(left, right, num, den) if left and right else []
        ids = [d for side in sides for d, _ in side]
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}).astype("int64")

    return held.groupBy("cluster", "bx", "px", "by", "py").applyInPandas(join, "a long, b long")


def similar_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs (doc_id, text): component_id is the smallest
    doc_id that links of Jaccard similarity num / den or more lead to."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(_signed(docs, words), "sets")
    key = F.struct("n", "k1", "k2")
    apart = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high")
    apart = materialise(apart.select(F.col("doc_id").alias("_apart")), "apart")
    if apart.isEmpty():
        return _classes(docs, signed, words, num, den)
    return _under_keys(docs, apart, words, num, den)


def _under_keys(docs: DataFrame, apart: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """similar_classes where the doc_ids in apart have texts that differ: these are searched for under keys, and what shares a doc_id is joined."""
    marked = docs.join(broadcast_if_small(apart), docs.doc_id == F.col("_apart"), "left")
    salt = 0
    while True:
        keyed = F.when(F.col("_apart").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text", F.lit(salt)))
        rows = materialise(marked.select(keyed.alias("key"), "doc_id", "text"), "keyed")
        owners = materialise(rows.where("key is not null").select("key", "doc_id", F.sha2("text", 256).alias("sha")).distinct(), "owners")
        moved = owners.join(broadcast_if_small(apart), owners.doc_id == F.col("_apart"), "left_semi")
        taken = docs.select(F.col("doc_id").alias("key"))
        if moved.groupBy("key").count().where("count > 1").isEmpty() and moved.join(taken, "key", "left_semi").isEmpty():
            break
        salt += 1
        discard(rows, owners)
    texts = rows.select(F.col("key").alias("doc_id"), "text")
    found = _classes(texts, materialise(_signed(texts, words), "sets"), words, num, den)
    found = found.withColumnRenamed("doc_id", "key").join(owners.select("key", "doc_id").distinct(), "key", "left")
    found = materialise(found, "found")
    linked = found.where("n_shingles > 0 and key is not null")
    edges = linked.join(broadcast_if_small(apart), linked.doc_id == F.col("_apart"), "left_semi").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    groups = connected_components(edges)
    group = F.coalesce("component", "component_id")
    found = found.join(groups, found.component_id == groups.node, "left").withColumn("group", group)
    least = found.where("n_shingles > 0 and key is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    found = found.join(least, "group", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, signed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """similar_classes where the texts of a doc_id are all equal; signed: the sets of docs."""
    real = signed.where("n > 0 and doc_id is not null")
    classes = materialise(real.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    # copies stay out of the search: each class is there once
    copies = materialise(real.join(classes, ["n", "k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("_copy")).distinct().join(classes.select(F.col("rep").alias("_copy")), "_copy", "left_anti"), "copies")
    once = docs.where("doc_id is not null").join(broadcast_if_small(copies), docs.doc_id == F.col("_copy"), "left_anti")
    w = Window.partitionBy("sig")
    met = _buckets(once, words, num, den).withColumns({"low": F.min("rep").over(w), "high": F.max("rep").over(w)})
    met = materialise(met.where("low <> high").select("sig", "rep"), "met")
    bits = real.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(F.max("n").alias("n"), F.max_by("bits", "n").alias("bits"))
    bits = materialise(bits, "bits")
    if small(bits, BITS // 8 + 32):  # then only bucket and set are dealt out, and the bitmaps are looked up there
        rows = met.repartition("sig").sortWithinPartitions("sig").join(F.broadcast(bits), "rep")
    else:
        rows = met.join(bits.hint("shuffle_merge"), "rep").repartition("sig").sortWithinPartitions("sig")
    rows = rows.select("sig", "rep", "n", "bits")
    edges = rows.mapInArrow(_bucket_edges(num, den), "a long, b long").where("a <> b").distinct()
    near = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    reps = classes.groupBy("rep").agg(F.max("n").alias("n"))
    clusters = materialise(reps.join(near, "rep"), "clusters")
    discard(met, bits, copies)
    links = materialise(_links(clusters, docs, words, num, den), "links")
    joined = materialise(connected_components(links).select(F.col("node").alias("rep"), "component"), "joined")
    by_set = classes.join(joined, "rep", "left")
    by_set = by_set.select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "k1", "k2").join(by_set, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Exact for whole tables, by a self-join on shared shingles and a recursive closure: for small tables only.
OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s FROM w, range(1, len(w) - least(len(w), 3) + 2) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, s FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
