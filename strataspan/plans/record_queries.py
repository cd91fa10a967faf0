"""Record operators and scalar functions applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions import units
from strataspan.operators import records
from strataspan.plans.interval_queries import table
from strataspan.plans.registry import query


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(
    "bit_runs",
    "WITH r AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, min(event_id) AS first, count(*) AS count FROM r GROUP BY event_type, k",
)
def bit_runs(spark: SparkSession, sf: str) -> DataFrame:
    return records.runs(table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("seek_offsets", "SELECT doc_id, source, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM documents")
def seek_offsets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return records.prefix_sum(docs, ["source"], "doc_id", "n_chars", 1024).select("doc_id", "source", F.col("offset").alias("offset_chars"))


@query(
    "latest_valid",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1",
)
def latest_valid(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return records.latest_valid(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "rates8",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value AS d FROM events),
w AS (SELECT *, first_value(t) OVER x AS t0, first_value(d) OVER x AS d0, min(t) OVER (PARTITION BY user_id) AS f FROM e WINDOW x AS (PARTITION BY user_id ORDER BY t, d ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN (t - t0) / 1000000.0 >= 0.5 THEN greatest(d - d0, 0) / ((t - t0) / 1000000.0) WHEN (t - f) / 1000000.0 > 0.5 THEN d / ((t - f) / 1000000.0) END AS rate FROM w""",
)
def rates8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", _us("ts").alias("t"), "value")
    return records.rates(e, ["user_id"], "t", "value").select("event_id", "rate")


@query(
    "overview48",
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT user_id, bar, avg(value) AS mean FROM e, range(0, 48) t(bar) WHERE n >= 4 AND i >= bar * n // 48 AND i < least(greatest((bar + 1) * n // 48, bar * n // 48 + 1), n) GROUP BY user_id, bar)
SELECT user_id, CAST(bar AS INTEGER) AS bar, round(mean, 6) AS mean, round(CASE WHEN max(mean) OVER (PARTITION BY user_id) > 0 THEN mean / max(mean) OVER (PARTITION BY user_id) * 0.92 ELSE 0 END, 6) AS height FROM b""",
)
def overview48(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    out = records.overview(e, ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", "bar", F.round("mean", 6).alias("mean"), F.round("height", 6).alias("height"))


@query("journal_override", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS BIGINT) ELSE d.n_chars % 2 END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def journal_override(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("quality"))
    journal = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return records.override(base, journal, ["doc_id"], ["quality"])


@query(
    "longest_prefix",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages),
m AS (SELECT DISTINCT regexp_extract(path, '^/[^/]*', 0) AS mount FROM p UNION SELECT DISTINCT regexp_extract(path, '^/[^/]*/[^/]*', 0) FROM p WHERE path LIKE '/%/%' UNION SELECT '/'),
j AS (SELECT page_id, p.path, mount, row_number() OVER (PARTITION BY page_id ORDER BY length(mount) DESC) AS r FROM p LEFT JOIN m ON mount = '/' OR p.path = mount OR starts_with(p.path, mount || '/'))
SELECT page_id, path, mount FROM j WHERE r = 1""",
)
def longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    host, folder = p.select(F.regexp_extract("path", "^/[^/]*", 0).alias("mount")), p.where("path like '/%/%'").select(F.regexp_extract("path", "^/[^/]*/[^/]*", 0).alias("mount"))
    mounts = host.unionByName(folder).unionByName(spark.sql("select '/' as mount")).distinct()
    return records.longest_prefix(p, "path", mounts, "mount")


@query(
    "recheck",
    """SELECT c.c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'gone' WHEN n.bal = c.c_acctbal AND n.c_name = c.c_name THEN 'same' ELSE 'changed' END AS state
FROM customer c LEFT JOIN (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 11 <> 0) n ON n.c_custkey = c.c_custkey""",
)
def recheck(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of customers against a later one, made by rule: every 11th is gone, every 7th has another balance."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return records.recheck(c, now, "c_custkey", ["c_name", "c_acctbal"])


@query(
    "mismatches",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""",
)
def mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded against counted orders of each customer."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    a, b = (x.groupBy("k").agg(F.count("*").alias("n")) for x in (o, o.where("o_orderkey % 10 <> 3")))
    return records.mismatches(a, b, ["k"], ["n"])


@query("subset_check", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def subset_check(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys of lines that the reduced order table doesn't hold: a left anti-join that should be empty for a subset."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").distinct().join(o, "l_orderkey", "left_anti")


@query("referenced", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def referenced(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that appear in large lines: a left semi-join."""
    used = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_semi")


@query(
    "detect_chain",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(t, '<!DOCTYPE') THEN 'html' WHEN starts_with(t, '<') THEN 'tag' WHEN starts_with(t, '#') THEN 'heading' WHEN regexp_matches(t, '^[A-Z][A-Z]') THEN 'upper' ELSE 'raw' END AS kind
FROM (SELECT html AS t FROM pages UNION ALL SELECT text FROM documents)) GROUP BY kind""",
)
def detect_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The first signature that matches, in a fixed order."""
    t = table(spark, sf, "pages").select(F.col("html").alias("t")).unionByName(table(spark, sf, "documents").select(F.col("text").alias("t")))
    head = F.substring("t", 1, 16)
    kind = records.first_problem((F.startswith(head, F.lit("<!DOCTYPE")), "html"), (F.startswith(head, F.lit("<")), "tag"), (F.startswith(head, F.lit("#")), "heading"), (head.rlike("^[A-Z][A-Z]"), "upper"), (F.lit(True), "raw"))
    return t.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "first_problem",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 49 THEN 'too many' WHEN l_discount >= 0.1 THEN 'discount of ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || ' %' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_tax = 0 THEN 'untaxed' END AS problem FROM lineitem""",
)
def first_problem(spark: SparkSession, sf: str) -> DataFrame:
    discount = F.concat(F.lit("discount of "), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit(" %"))
    problem = records.first_problem((F.col("l_quantity") > 49, "too many"), (F.col("l_discount") >= 0.1, discount), (F.col("l_returnflag") == "R", "returned"), (F.col("l_tax") == 0, "untaxed"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", problem.alias("problem"))


_HUMAN = """CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' ELSE (CASE WHEN v < 9.995 THEN printf('%.2f', v) WHEN v < 99.95 THEN printf('%.1f', v) ELSE printf('%.0f', v) END) || ' ' || unit END"""


@query(
    "human_bytes",
    f"""WITH d AS (SELECT DISTINCT n_chars * n_chars * n_chars AS n FROM documents),
k1 AS (SELECT n, n / 1000.0::DOUBLE AS a FROM d), k2 AS (SELECT n, a, a / 1000.0::DOUBLE AS b FROM k1), k3 AS (SELECT n, a, b, b / 1000.0::DOUBLE AS c FROM k2), k4 AS (SELECT n, a, b, c, c / 1000.0::DOUBLE AS e, c / 1000.0::DOUBLE / 1000.0::DOUBLE AS f FROM k3),
u AS (SELECT n, CASE WHEN a < 999.5 THEN a WHEN b < 999.5 THEN b WHEN c < 999.5 THEN c WHEN e < 999.5 THEN e ELSE f END AS v, CASE WHEN a < 999.5 THEN 'kB' WHEN b < 999.5 THEN 'MB' WHEN c < 999.5 THEN 'GB' WHEN e < 999.5 THEN 'TB' ELSE 'PB' END AS unit FROM k4)
SELECT n, {_HUMAN} AS size FROM u""",
)
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select((F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("n")).distinct()
    return n.withColumn("size", units.human_bytes("n"))


@query(
    "human_duration",
    """WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS s FROM events), r AS (SELECT event_id, s, CAST(floor(greatest(s, 0) + 0.5) AS BIGINT) AS k FROM g)
SELECT event_id, CASE WHEN s IS NULL THEN NULL WHEN s > 0 AND s < 0.5 THEN '<1s' WHEN k < 60 THEN k || 's' WHEN k < 3600 THEN (k // 60) || 'm ' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || 's' ELSE (k // 3600) || 'h ' || lpad(CAST(k // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS gap FROM r""",
)
def human_duration(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (_us("ts") - F.lag(_us("ts")).over(w)) / 1e6
    e = table(spark, sf, "events").withColumn("s", gap)
    return e.select("event_id", F.when(F.col("s").isNotNull(), units.human_duration(F.col("s"))).alias("gap"))


@query("block_size", "WITH n AS (SELECT DISTINCT n_chars * 1024 * (CASE WHEN n_chars % 3 = 0 THEN 1024 ELSE 1 END) + (n_chars % 2) AS n FROM documents) SELECT n, CASE WHEN n >= 1073741824 AND n % 1073741824 = 0 THEN (n // 1073741824) || 'G' WHEN n >= 1048576 AND n % 1048576 = 0 THEN (n // 1048576) || 'M' WHEN n >= 1024 AND n % 1024 = 0 THEN (n // 1024) || 'K' ELSE CAST(n AS VARCHAR) END AS text FROM n")
def block_size(spark: SparkSession, sf: str) -> DataFrame:
    scale = F.when(F.col("n_chars") % 3 == 0, 1024).otherwise(1)
    n = table(spark, sf, "documents").select((F.col("n_chars") * 1024 * scale + F.col("n_chars") % 2).alias("n")).distinct()
    return n.withColumn("text", units.block_size(F.col("n")))


@query(
    "parse_size",
    """WITH t AS (SELECT DISTINCT p_size || (CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN 'MiB' WHEN 3 THEN 'G' WHEN 4 THEN 'TiB' ELSE 'X' END) AS t FROM part)
SELECT t, CASE WHEN regexp_matches(t, '^[0-9]+(K|k|KiB|M|MiB|G|GiB|T|TiB|)$') THEN CAST(regexp_extract(t, '^[0-9]+') AS BIGINT) * (CASE upper(substr(regexp_replace(t, '^[0-9]+', ''), 1, 1)) WHEN '' THEN 1 WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1099511627776 END) END AS bytes FROM t""",
)
def parse_size(spark: SparkSession, sf: str) -> DataFrame:
    units_ = F.element_at(F.array(*map(F.lit, ["", "K", "MiB", "G", "TiB", "X"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    t = table(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), units_).alias("t")).distinct()
    return t.withColumn("bytes", units.parse_size(F.col("t")))


@query("fs_names", "SELECT o_orderstatus AS code, count(*) AS n, CASE o_orderstatus WHEN 'F' THEN 'FAT' WHEN 'O' THEN 'exFAT' ELSE o_orderstatus END AS name FROM orders GROUP BY 1")
def fs_names(spark: SparkSession, sf: str) -> DataFrame:
    blkid = F.when(F.col("code") == "F", "vfat").when(F.col("code") == "O", "exfat").otherwise(F.col("code"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n")).withColumn("name", units.fs_name(blkid))


@query("tidy_names", "SELECT p_partkey, trim(regexp_replace(replace(p_brand || '__' || p_type || ' ', '_', ' '), '\\s+', ' ', 'g')) AS name FROM part")
def tidy_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", units.tidy(F.concat("p_brand", F.lit("__"), "p_type", F.lit(" "))).alias("name"))


@query(
    "json_coerce",
    "SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS BIGINT) AS k, coalesce(json_extract_string(props, '$.k') IN ('1', 'true', 'True'), false) AS flag FROM events",
)
def json_coerce(spark: SparkSession, sf: str) -> DataFrame:
    from strataspan.functions import loose_json

    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", loose_json.number(v, "k").alias("k"), loose_json.flag(v, "k").alias("flag"))


@query("natural_sort_key", "SELECT c_custkey, regexp_replace(c_name, '[0-9]*$', '') AS head, coalesce(TRY_CAST(regexp_extract(c_name, '([0-9]*)$', 1) AS BIGINT), 0) AS number FROM customer")
def natural_sort_key(spark: SparkSession, sf: str) -> DataFrame:
    key = records.natural_key(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", key["head"].alias("head"), key["number"].alias("number"))


@query("first_seen_distinct", "SELECT lang, min(doc_id) AS first_seen FROM documents GROUP BY lang")
def first_seen_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return records.first_seen(table(spark, sf, "documents"), "lang", "doc_id")


@query("drop_neighbours", "SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def drop_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return records.drop_neighbours(e, ["user_id"], "event_id", "event_type").select("event_id", "user_id")


@query("last_messages", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    return records.last_rows(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


@query("popcount_check", "SELECT l_returnflag, CAST(sum(bit_count(CAST(l_quantity AS BIGINT))) AS BIGINT) AS bits FROM lineitem GROUP BY 1")
def popcount_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(F.bit_count(F.col("l_quantity").cast("long"))).cast("long").alias("bits"))


@query("min_by_rank", "SELECT l_orderkey, min(l_linenumber) AS line, arg_min(l_partkey, {'n': l_linenumber, 'p': l_partkey}) AS part FROM lineitem GROUP BY 1")
def min_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part"))


@query("copy_window", "SELECT o_orderkey, CAST(least(greatest(CAST(round(o_totalprice) AS BIGINT) - 3 * 4096, 0), 16 * 4096) AS BIGINT) AS total FROM orders")
def copy_window(spark: SparkSession, sf: str) -> DataFrame:
    """Skip 3 and count 16 blocks of 4096."""
    size = F.round("o_totalprice").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", F.least(F.greatest(size - 3 * 4096, F.lit(0)), F.lit(16 * 4096)).cast("long").alias("total"))
