"""Range-algebra operators applied to the driver's tables: an event occupies a minute, a user stands for a drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.operators import extents
from strataspan.plans.registry import query

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_ranges(spark: SparkSession, sf: str, length: int = 60_000_000) -> DataFrame:
    """(user_id, start, end) in microseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("user_id", us.alias("start"), (us + length).alias("end"))


def islands(spark: SparkSession, sf: str) -> DataFrame:
    return extents.merge_gap(event_ranges(spark, sf), ["user_id"], HOUR_US)


def month(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, low, high): every user from the first day of the events to the end of the last; two numbers are broadcast."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events")
    ends = e.agg((F.min(us) - F.pmod(F.min(us), F.lit(DAY_US))).alias("low"), (F.max(us) - F.pmod(F.max(us), F.lit(DAY_US)) + DAY_US).alias("high"))
    return e.select("user_id").distinct().join(F.broadcast(ends))


def days(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, start, end): every day of every user."""
    m = month(spark, sf).withColumn("start", F.explode(F.sequence("low", F.col("high") - 1, F.lit(DAY_US).cast("long"))))
    return m.select("user_id", "start", (F.col("start") + DAY_US).alias("end"))


ISLANDS_SQL = """a AS (SELECT user_id, epoch_us(ts) AS s, MAX(epoch_us(ts) + 60000000) AS e FROM events GROUP BY user_id, epoch_us(ts)),
b AS (SELECT *, MAX(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM a),
c AS (SELECT *, SUM(CASE WHEN pm IS NULL OR (s > pm AND s - pm >= 3600000000) THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b),
isl AS (SELECT user_id, MIN(s) AS s, MAX(e) AS e FROM c GROUP BY user_id, k)"""
BOUNDS_SQL = """bounds AS (SELECT min(epoch_us(ts)) - min(epoch_us(ts)) % 86400000000 AS low, max(epoch_us(ts)) - max(epoch_us(ts)) % 86400000000 + 86400000000 AS high FROM events),
u AS (SELECT user_id, low, high FROM (SELECT DISTINCT user_id FROM events), bounds),
d AS (SELECT user_id, low + 86400000000 * i AS ds, low + 86400000000 * (i + 1) AS de FROM u, range(0, CAST((SELECT (high - low) // 86400000000 FROM bounds) AS BIGINT)) t(i))"""


@query("merge_gap", f"WITH {ISLANDS_SQL} SELECT user_id, s AS start_us, e - s AS len_us FROM isl")
def merge_gap(spark: SparkSession, sf: str) -> DataFrame:
    return islands(spark, sf).select("user_id", F.col("start").alias("start_us"), (F.col("end") - F.col("start")).alias("len_us"))


@query(
    "merge_gap_cells",
    """WITH a AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + 60000000 AS e FROM events GROUP BY ALL),
b AS (SELECT *, MAX(e) OVER (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM a),
c AS (SELECT *, SUM(CASE WHEN pm IS NULL OR (s > pm AND s - pm >= 120000000) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT event_type, MIN(s) AS start_us, MAX(e) - MIN(s) AS len_us FROM c GROUP BY event_type, k""",
)
def merge_gap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys with very many ranges each: cells of a day are merged first."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ranges = table(spark, sf, "events").select("event_type", us.alias("start"), (us + 60_000_000).alias("end"))
    out = extents.merge_gap(ranges, ["event_type"], 120_000_000, width=DAY_US)
    return out.select("event_type", F.col("start").alias("start_us"), (F.col("end") - F.col("start")).alias("len_us"))


@query(
    "normalize_extents",
    """WITH p AS (SELECT max(epoch_us(ts)) AS size FROM events),
a0 AS (SELECT user_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS s, least(least(epoch_us(ts) + 60000000, size) + (3600000000 - least(epoch_us(ts) + 60000000, size) % 3600000000) % 3600000000, size) AS e FROM events, p),
a AS (SELECT user_id, s, max(e) AS e FROM a0 WHERE s < e GROUP BY user_id, s),
b AS (SELECT *, MAX(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM a),
c AS (SELECT *, SUM(CASE WHEN pm IS NULL OR (s > pm AND s - pm >= 3600000000) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b),
m AS (SELECT user_id, MIN(s) AS s, MAX(e) AS e FROM c GROUP BY user_id, k),
g AS (SELECT user_id, s, e, s - lag(e) OVER (PARTITION BY user_id ORDER BY s) AS apart FROM m),
t AS (SELECT user_id, 3600000000 AS g0, list(apart) AS l, count(*) AS n FROM g GROUP BY user_id),
f AS (SELECT user_id, (SELECT min(x) FROM (SELECT CASE WHEN i = 0 THEN g0 ELSE CAST(g0 * pow(2, i) AS BIGINT) END AS x FROM range(0, 20) r(i)) WHERE 1 + len(list_filter(l, lambda v: v >= x)) <= 4) AS gap FROM t),
h AS (SELECT g.*, SUM(CASE WHEN apart IS NULL OR apart >= gap THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM g JOIN f ON g.user_id = f.user_id)
SELECT user_id, CAST(min(s) AS BIGINT) AS start_us, CAST(max(e) AS BIGINT) AS end_us FROM h GROUP BY user_id, k""",
)
def normalize_extents(spark: SparkSession, sf: str) -> DataFrame:
    size = table(spark, sf, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("size"))
    ranges = event_ranges(spark, sf).join(F.broadcast(size))
    ranges = extents.align_out(ranges, HOUR_US, F.col("size"))
    out = extents.normalize(ranges, ["user_id"], F.lit(2**62), gap=HOUR_US, align=1, limit=4)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    "complement",
    f"""WITH {ISLANDS_SQL}, {BOUNDS_SQL},
x AS (SELECT isl.user_id, least(greatest(s, low), high) AS s, greatest(least(e, high), low) AS e, low, high FROM isl JOIN u ON u.user_id = isl.user_id),
y AS (SELECT user_id, coalesce(max(e) OVER w, low) AS fs, s AS fe FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) UNION ALL SELECT user_id, max(e), any_value(high) FROM x GROUP BY user_id)
SELECT user_id, CAST(fs AS BIGINT) AS idle_start, CAST(fe AS BIGINT) AS idle_end FROM y WHERE fs < fe""",
)
def complement(spark: SparkSession, sf: str) -> DataFrame:
    out = extents.complement(islands(spark, sf), ["user_id"], month(spark, sf))
    return out.select("user_id", F.col("start").alias("idle_start"), F.col("end").alias("idle_end"))


@query(
    "overlap_per_window",
    f"""WITH {ISLANDS_SQL}, {BOUNDS_SQL}
SELECT d.user_id, CAST(ds AS BIGINT) AS day_us, CAST(coalesce(sum(CASE WHEN s IS NOT NULL THEN least(e, de) - greatest(s, ds) END), 0) AS BIGINT) AS used_us
FROM d LEFT JOIN isl ON isl.user_id = d.user_id AND s < de AND ds < e GROUP BY d.user_id, ds""",
)
def overlap_per_window(spark: SparkSession, sf: str) -> DataFrame:
    out = extents.overlap_sum(islands(spark, sf), days(spark, sf), ["user_id"], DAY_US)
    return out.select("user_id", F.col("start").alias("day_us"), F.col("used").cast("long").alias("used_us"))


@query("free_frames", f"WITH {ISLANDS_SQL}, {BOUNDS_SQL} SELECT user_id, CAST(ds AS BIGINT) AS day_us FROM d WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.user_id = d.user_id AND s < de AND ds < e)")
def free_frames(spark: SparkSession, sf: str) -> DataFrame:
    out = extents.range_join(days(spark, sf), islands(spark, sf), ["user_id"], DAY_US, "left_anti")
    return out.select("user_id", F.col("start").alias("day_us"))


@query(
    "not_covered",
    f"""WITH {ISLANDS_SQL}, {BOUNDS_SQL}
SELECT isl.user_id, CAST(s AS BIGINT) AS start_us, CAST(e AS BIGINT) AS end_us FROM isl WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = isl.user_id AND ds <= s AND e <= de)""",
)
def not_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Islands that lie within no single day."""
    out = extents.not_covered(islands(spark, sf), days(spark, sf), ["user_id"], DAY_US)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    "overlap_check",
    """WITH r AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events),
p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)
SELECT user_id, s AS start_us, pe AS previous_end_us FROM p WHERE pe > s""",
)
def overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    out = extents.conflicts(event_ranges(spark, sf, HOUR_US), ["user_id"])
    return out.select("user_id", F.col("start").alias("start_us"), F.col("previous_end").alias("previous_end_us"))


@query("cut_pieces", "SELECT doc_id, CAST(i AS BIGINT) AS piece_start, CAST(least(512, n_chars - i) AS BIGINT) AS piece_len FROM documents, range(0, n_chars, 512) t(i)")
def cut_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"))
    return extents.cut_pieces(docs, 512).select("doc_id", F.col("start").alias("piece_start"), (F.col("end") - F.col("start")).alias("piece_len"))


@query(
    "zero_pieces",
    """WITH n AS (SELECT DISTINCT n_chars * 100003 AS len FROM documents),
p AS (SELECT len, CAST(67108864 AS BIGINT) AS piece FROM n, range(0, len // 67108864) t(i)
 UNION ALL SELECT len, CAST(pow(2, i) AS BIGINT) FROM n, range(12, 26) t(i) WHERE ((len % 67108864) & CAST(pow(2, i) AS BIGINT)) <> 0
 UNION ALL SELECT len, len % 4096 FROM n WHERE len % 4096 > 0)
SELECT CAST(len AS BIGINT) AS len, CAST(piece AS BIGINT) AS piece, count(*) AS pieces FROM p GROUP BY len, piece""",
)
def zero_pieces(spark: SparkSession, sf: str) -> DataFrame:
    lens = table(spark, sf, "documents").select((F.col("n_chars") * 100_003).alias("len")).distinct()
    return lens.withColumn("piece", F.explode(extents.zero_pieces(F.col("len")))).groupBy("len", "piece").agg(F.count("*").alias("pieces"))


@query(
    "remap_ranges",
    """WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e, CAST(l_quantity AS BIGINT) AS q, l_partkey FROM lineitem),
seg AS (SELECT l_orderkey, e - q AS s, e, l_partkey * 100000 AS target FROM l),
r AS (SELECT o_orderkey, 10 AS s, 30 AS e FROM orders)
SELECT o_orderkey, CAST(target + greatest(r.s, seg.s) - seg.s AS BIGINT) AS start_at, CAST(target + least(r.e, seg.e) - seg.s AS BIGINT) AS end_at FROM r JOIN seg ON l_orderkey = o_orderkey AND r.s < seg.e AND seg.s < r.e""",
)
def remap_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Units 10 to 30 of every order, found in the parts they are made of."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("l_quantity").cast("long")).over(w)
    seg = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (end - F.col("l_quantity").cast("long")).alias("start"), end.alias("end"), (F.col("l_partkey") * 100_000).alias("target"))
    asked = table(spark, sf, "orders").select("o_orderkey", F.lit(10).cast("long").alias("start"), F.lit(30).cast("long").alias("end"))
    return extents.remap(asked, seg, ["o_orderkey"], 1000).select("o_orderkey", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(
    "point_in_range",
    f"WITH {ISLANDS_SQL} SELECT event_id, ev.user_id, CAST(epoch_us(ts) - s AS BIGINT) AS into_us FROM events ev JOIN isl ON isl.user_id = ev.user_id AND s <= epoch_us(ts) AND epoch_us(ts) < e",
)
def point_in_range(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = extents.locate(points, islands(spark, sf), ["user_id"], "at", DAY_US)
    return out.select("event_id", "user_id", (F.col("at") - F.col("r_start")).alias("into_us"))


@query(
    "overlay_patches",
    """WITH p AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e, event_id FROM events),
x AS (SELECT user_id, s AS x FROM p UNION SELECT user_id, e FROM p),
c AS (SELECT user_id, x AS s, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS e FROM x)
SELECT c.user_id, c.s AS start_us, c.e AS end_us, max(event_id) AS event_id FROM c JOIN p ON p.user_id = c.user_id AND p.s <= c.s AND c.e <= p.e GROUP BY ALL""",
)
def overlay_patches(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    p = table(spark, sf, "events").select("user_id", us.alias("start"), (us + 2 * HOUR_US).alias("end"), "event_id")
    return extents.overlay(p, ["user_id"], "event_id", 6 * HOUR_US).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "event_id")
