"""Chat formatting with cumulative-snapshot collapse (operator 7), in DataFrame functions only.

A logged conversation is often stored again and again as it grows. Every turn gets a hash of its conversation up
to and with it: running sums of position-salted hashes, four of 32 bits each, so a window keeps one row in hand
and no conversation is collected to be compared. A conversation goes if its last hash is a shorter prefix hash of
another (an anti-join whose two sides are grouped first, so a turn that a third of all logs open with is one row),
or if an equal one has a smaller conv_id. What is left is rendered. The hashes are written to the shared folder
once, without the texts: prefixes and ends read them there, and only conversations that stay are put in order again.

Defined results: turns are ordered by turn, role, text, nulls first; a null role or text is empty; repeated rows
are repeated turns; rows without a conv_id belong to no conversation and are left out; texts are hashed and
rendered whole, however long; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import materialise, table

HASHES = ["_p0", "_p1", "_p2", "_p3"]


def _turns(conv: DataFrame) -> DataFrame:
    """(conv_id, role, text, _i from 1, whether it is the _last)."""
    t = conv.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = t.withColumns({"_i": F.row_number().over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    return t.drop("turn")


def _marks(conv: DataFrame) -> DataFrame:
    """(conv_id, _i, _last, hashes of the turns up to and with this one), written to the shared folder."""
    t = _turns(conv)
    first, second = F.xxhash64("_i", "role", "text"), F.xxhash64(F.lit(7), "text", "_i", "role")
    parts = [first.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(first, 32), second.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(second, 32)]
    t = t.select("conv_id", "_i", "_last", *[p.alias(f"_h{k}") for k, p in enumerate(parts)])
    run = Window.partitionBy("conv_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return materialise(t.select("conv_id", "_i", "_last", *[F.sum(f"_h{k}").over(run).alias(p) for k, p in enumerate(HASHES)]), "marks")


def maximal(conv: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay."""
    marks = _marks(conv)
    prefixes = marks.where("not _last").select("_i", *HASHES).distinct()
    ends = marks.where("_last").groupBy("_i", *HASHES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = ends.join(prefixes, ["_i", *HASHES], "left_anti")
    return kept.select("conv_id", F.col("_i").cast("long").alias("n_turns"), "n_copies")


def chat_format(conv: DataFrame, before: str = "<|im_start|>", after: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, n_copies, text): one row for each maximal conversation, rendered as
    before + role + newline + text + after for each turn."""
    kept = maximal(conv)
    said = F.concat(F.lit(before), F.col("role"), F.lit("\n"), F.col("text"), F.lit(after))
    turns = _turns(conv.join(kept.select("conv_id"), "conv_id", "left_semi"))
    body = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_i", said.alias("said")))).alias("turns"))
    return body.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join("turns.said", "").alias("text"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, i, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
       list(md5(role) || md5(text)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre FROM t),
e AS (SELECT pre, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE i = n GROUP BY pre, n),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = e.n AND p.pre = e.pre))
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.i) AS text
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL
"""
