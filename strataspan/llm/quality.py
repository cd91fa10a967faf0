"""Quality classifier (operator 6): random Fourier features over document statistics, ridge, isotonic calibration.

The statistics are counts over the whole text and the most extreme line of it (a document with one junk line in
many good ones must stand out): shares of upper case, digits, symbols, bars and exclamation marks, words that repeat the one
before, distinct words and word pairs. Random Fourier features approximate a Gaussian kernel over them. Each partition of
labelled rows sums its normal equations, and the driver adds at most `PARTS` such sums of fixed size, so the fit does not
grow with the corpus. Pool-adjacent-violators then maps ridge outputs to probabilities, on one in CALIBRATION of the labelled rows, which the ridge
is not fitted on (on all of them if they are too few to be parted).

The fit uses at most `sample` labelled rows (a hash of doc_id picks them when there are more); scoring covers every text.

Defined results: a null text counts as empty; empty texts get the score of their statistics, all zero; without any usable label
every score is 0.5; a null doc_id is not held out; repeated labels count repeatedly; a null label isn't used; repeated documents get equal scores, very long
texts are counted whole, an empty table has no scores, and columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import discard, materialise, table
from strataspan.llm.shingles import batches, mix, word_hashes

SAMPLE, PARTS = 200_000, 16
FEATURES, RIDGE = 512, 1e-4
THRESHOLD = 0.3
#: One labelled document in so many calibrates; fewer than LEAST of them calibrate nothing.
CALIBRATION, LEAST = 5, 40

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BAR, _BANG, _PUNCT, _HIGH = range(8)
_CLASS = np.full(256, 8, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b"#$%&*<>{}[]\\^~=+@_/":
    _CLASS[_c] = _SYMBOL
for _c in b".,;:'\"()-?":
    _CLASS[_c] = _PUNCT
_CLASS[ord("|")], _CLASS[ord("!")] = _BAR, _BANG


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x between consecutive starts; empty stretches are 0."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _ratios(counts: list[np.ndarray], size: np.ndarray, words: np.ndarray, same: np.ndarray) -> list[np.ndarray]:
    letters = np.maximum(1, counts[_UPPER] + counts[_LOWER] + counts[_HIGH] / 2)
    w = np.maximum(1, words)
    return [counts[_UPPER] / letters, counts[_SYMBOL] / w, counts[_BAR] / w, counts[_BANG] / w, counts[_DIGIT] / np.maximum(1, size), counts[_PUNCT] / w, same / w]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text."""
    out = []
    for part in batches(texts):
        raw = [(t or "").encode() for t in texts[part]]
        hashes, bounds = word_hashes(texts[part])
        buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        kind = _CLASS[buf]
        doc_at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        line_at = np.concatenate([[0], np.flatnonzero(buf == 10) + 1])
        white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        begins = ~white & np.concatenate([[True], white[:-1]])
        word_at = np.concatenate([[0], np.cumsum(begins)])
        again = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        again[bounds[:-1][bounds[:-1] < len(again)]] = False  # a text's first word repeats none
        sums = {}
        for name, at in (("doc", doc_at), ("line", line_at)):
            w_at = word_at[at]
            sums[name] = _ratios([_sums(kind == c, at) for c in range(8)], np.diff(at), np.diff(w_at), _sums(again, w_at)), np.diff(w_at)
        doc, words = sums["doc"]
        line, line_words = sums["line"]
        first_line = np.searchsorted(line_at, doc_at[:-1])
        long_enough = line_words >= 8
        peaks = [np.maximum.reduceat(np.where(long_enough, x, 0), first_line) for x in line]
        pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
        distinct, distinct_pairs, top = np.zeros(len(raw)), np.zeros(len(raw)), np.zeros(len(raw))
        for i in range(len(raw)):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                _, n = np.unique(hashes[a:b], return_counts=True)
                distinct[i], top[i] = len(n) / (b - a), n.max() / (b - a)
                distinct_pairs[i] = len(np.unique(pairs[a : b - 1])) / (b - 1 - a) if b - a > 1 else 1
        length = np.diff(doc_at) - 1
        out.append(np.column_stack([*doc, *peaks, distinct, distinct_pairs, top, np.log1p(length), np.log1p(words), length / np.maximum(1, words), (np.diff(np.searchsorted(line_at, doc_at))) / np.maximum(1, words)]))
    return np.concatenate(out) if out else np.zeros((0, 21))


class Model:
    """Ridge over random Fourier features of standardised statistics, and the calibration of its output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7, features: int = FEATURES):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[a : a + 512]) @ self.weights for a in range(0, max(1, len(x)), 512)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ascending step means of y in order of x, as points for interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, smallest x, largest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    points = [(p, s / n) for s, n, low, high in blocks for p in ({low, high} if low != high else {low})]
    points.sort()
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


def _partial(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum over partitions of work(statistics, labels), an array of `size` numbers."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches_:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
                total += work(x, batch.column(1).to_numpy())
        yield pa.record_batch([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["s"])

    return np.sum([np.frombuffer(r.s, dtype="<f8") for r in rows.mapInArrow(run, "s binary").collect()], axis=0)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model | None:
    """Learn from labels (doc_id, quality) outside the held-out fold; None if there are none."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    known = known.select(F.col("doc_id").alias("_doc"), F.col("quality").cast("double").alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("_doc"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    docs = docs.select("doc_id", "text")
    apart = F.pmod(F.xxhash64(F.lit(1), "_doc"), F.lit(CALIBRATION)) == 0
    rows = docs.join(F.broadcast(known), docs.doc_id == known._doc).select("text", "y", apart.alias("apart"))  # `sample` rows or so of 16 bytes

    def stats(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            x = statistics(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), *batch.columns[1:]], names=["x", "y", "apart"])

    labelled = materialise(rows.mapInArrow(stats, "x binary, y double, apart boolean"), "labelled")
    kept = {r["apart"]: r["n"] for r in labelled.groupBy("apart").agg(F.count("*").alias("n")).collect()}
    parted = min(kept.get(True, 0), kept.get(False, 0)) >= LEAST
    rows = labelled.where("not apart" if parted else "true").select("x", "y").coalesce(PARTS)
    dim = statistics([""]).shape[1]
    s = _partial(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * dim + 1)
    if not s[0]:
        discard(labelled)
        return None
    mean = s[1 : dim + 1] / s[0]
    model = Model(mean, np.sqrt(np.maximum(s[dim + 1 :] / s[0] - mean**2, 1e-8)))
    d = len(model.weights)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(d * d + d)
        for a in range(0, len(x), 512):
            z = model.features(x[a : a + 512])
            total += np.concatenate([(z.T @ z).ravel(), z.T @ y[a : a + 512]])
        return total

    t = _partial(rows, normal, d * d + d)
    model.weights = np.linalg.solve(t[: d * d].reshape(d, d) + RIDGE * s[0] * np.eye(d), t[d * d :])

    def outputs(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
            yield pa.record_batch([pa.array(model.raw(x) if len(x) else np.zeros(0)), batch.column(1)], names=["x", "y"])

    pairs = labelled.where("apart" if parted else "true").select("x", "y").coalesce(PARTS).mapInArrow(outputs, "x double, y double").toPandas()  # `sample` rows at most
    discard(labelled)
    model.steps = isotonic(pairs["x"].to_numpy(), pairs["y"].to_numpy())
    return model


def held_out(doc_id, folds: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_column(model: Model | None, text):
    """A column with the quality of a text, 0 to 1."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(texts.tolist())))

    return score(text)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
