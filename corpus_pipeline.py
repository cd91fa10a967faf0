"""The corpus pipeline: each stage takes the documents that the one before it kept, written as Parquet and read again.

quality        documents that the quality classifier rejects go
line_dedup     lines found in an earlier document go, the documents stay
ngram_join     one document of each group of near copies stays, the one with the smallest doc_id (5-word shingles, 0.8)
decontaminate  documents that hold a benchmark item go (5-word shingles, containment 0.8)
byte_bpe       what is left is encoded to token ids and decoded again: doc_id, n_tokens and two hashes

All but the last return the columns of documents, n_chars being the length of the text as it is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm import byte_bpe, decontam, line_dedup, ngram_join, quality
from strataspan.llm.common import broadcast_if_small, materialise, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids (one column, materialised); a null doc_id stays."""
    gone = broadcast_if_small(ids.select(ids[0].alias("__gone_id")).distinct(), 16)
    return docs.join(gone, docs.doc_id == gone["__gone_id"], "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier (operator 6) scores below its threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__quality_score", quality.score_column(model, F.col("text"))).where(F.col("__quality_score") >= quality.THRESHOLD).drop("__quality_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go (operator 4)."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (operator 2) the document with the smallest doc_id stays, and of repeated rows one."""
    classes = ngram_join.similar_classes(docs, words=5, num=80, den=100)
    gone = classes.where("doc_id <> component_id").select("doc_id")
    kept = _without(docs, materialise(gone, "near-copies"))
    ids = materialise(kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    if ids.isEmpty():
        return kept
    again = kept.join(broadcast_if_small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, ids).unionByName(again.select(*kept.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (operator 3) go."""
    pairs = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialise(pairs.select("doc_id").distinct(), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (operator 1) as counts and hashes, decoded again."""
    import public_tokenizers as vocab

    return byte_bpe.digests(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}-{name}", "zstd")
    return docs
