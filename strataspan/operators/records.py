"""Record operators: newest valid record, overrides, prefix sums, runs, prefix lookups, rates and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BARS = 48


def latest_valid(df: DataFrame, keys: list[str], order: list[str], valid: Column) -> DataFrame:
    """Of each key's rows that pass `valid`, the one with the largest order. Combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.where(valid).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")


def override(base: DataFrame, journal: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with `columns` taken from the journal where it has the key."""
    j = journal.select(*keys, *[F.col(c).alias(f"_j_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base.join(j, keys, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_j_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_j_{c}" for c in columns])


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str = "offset") -> DataFrame:
    """Adds the sum of `value` over the key's rows before this one. In two levels, for a key that may hold most rows: sums of cells of
    `width` of the (integer) order, which combine on the map side, then a window within each cell."""
    cell = F.floor(F.col(order) / width)
    rows = df.withColumn("_cell", cell)
    sums = rows.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, [*keys, "_cell"])
    return joined.withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")).drop("_cell", "_before")


def runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions in each key: (keys, first, count). Positions are distinct in a key."""
    w = Window.partitionBy(*keys).orderBy(position)
    run = df.withColumn("_run", F.col(position) - F.row_number().over(w))
    return run.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.count("*").alias("count")).drop("_run")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the order of their first sight."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen"))


def drop_neighbours(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Rows whose value differs from the row before: removes repeats of neighbours only."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    return df.withColumn("_first", n == 1).withColumn("_before", F.lag(column).over(w)).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(column))).drop("_first", "_before")


def ancestors(path: Column) -> Column:
    """A path and all folders above it, the root last: each ends at a path boundary."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.when((n == 1) & (F.get(parts, F.lit(0)) == ""), F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))


def longest_prefix(paths: DataFrame, path: str, mounts: DataFrame, mount: str) -> DataFrame:
    """Each path with the longest mount that holds it; paths without one are kept with nulls. An equi-join on the folders above a
    path, not a comparison of all pairs."""
    names = paths.columns
    m = mounts.withColumn("_at", F.rtrim(F.col(mount), F.lit("/"))).withColumn("_at", F.when(F.col("_at") == "", F.lit("/")).otherwise(F.col("_at")))
    spread = paths.withColumn("_at", F.explode(ancestors(F.col(path))))
    rest = mounts.columns
    found = spread.join(m, "_at").groupBy(*names).agg(F.max_by(F.struct(*rest), F.length("_at")).alias("_m"))
    return paths.join(found, names, "left").select(*names, *[F.col(f"_m.{c}").alias(c) for c in rest])


def recheck(chosen: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state): `same` if all columns are as they were, `changed`, or `gone`."""
    n = now.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    state = F.when(F.col("_hit").isNull(), "gone").when(same, "same").otherwise("changed")
    return chosen.join(n, key, "left").select(key, state.alias("state"))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that only one side has, or that differ in a column: empty if both say the same."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_b"))
    differ = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        differ = differ | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return a.join(b, keys, "full").where(differ).select(*keys, F.coalesce("_a", F.lit(False)).alias("in_left"), F.coalesce("_b", F.lit(False)).alias("in_right"))


def last_rows(df: DataFrame, keys: list[str], order: str, count: int = 20) -> DataFrame:
    """The last `count` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def rates(df: DataFrame, keys: list[str], time_us: str, done: str, samples: int = 8) -> DataFrame:
    """Adds `rate`: change of `done` a second over the latest `samples` rows if they span half a second, else the mean since the
    key's first row if that is over half a second ago, else null."""
    w = Window.partitionBy(*keys).orderBy(time_us, done)
    recent, start = w.rowsBetween(1 - samples, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    t0, d0 = F.first(time_us).over(recent), F.first(done).over(recent)
    first = F.first(time_us).over(start)
    span, since = (F.col(time_us) - t0) / 1e6, (F.col(time_us) - first) / 1e6
    return df.withColumn("rate", F.when(span >= 0.5, F.greatest(F.col(done) - d0, F.lit(0)) / span).when(since > 0.5, F.col(done) / since))


def overview(df: DataFrame, keys: list[str], order: list[str], value: str, bars: int = BARS) -> DataFrame:
    """(keys, bar, mean, height): the key's history in `bars` means. Bar i covers rows i n / bars up to (i + 1) n / bars in integer
    division, at least one; keys with fewer than 4 rows have none. height: 0.92 for the highest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n >= 4")
    # the bars that hold row i: those with first <= i < last
    low = F.greatest(F.floor((F.col("_i") * bars) / F.col("_n")).cast("int") - 1, F.lit(0))
    high = F.least(F.floor(((F.col("_i") + 1) * bars) / F.col("_n")).cast("int") + 1, F.lit(bars - 1))
    spread = rows.withColumn("bar", F.explode(F.sequence(low, high)))
    first = F.floor(F.col("bar") * F.col("_n") / bars)
    last = F.least(F.greatest(F.floor((F.col("bar") + 1) * F.col("_n") / bars), first + 1), F.col("_n"))
    means = spread.where((F.col("_i") >= first) & (F.col("_i") < last)).groupBy(*keys, "bar").agg(F.avg(value).alias("mean"))
    top = F.max("mean").over(Window.partitionBy(*keys))
    return means.withColumn("height", F.when(top > 0, F.col("mean") / top * 0.92).otherwise(0.0))


def natural_key(name: Column) -> Column:
    """(head, number): sorts disk10 after disk2. Digits that don't fit 64 bits count as 0."""
    tail = F.regexp_extract(name, "([0-9]*)$", 1)
    head = F.substring(name, F.lit(1), F.length(name) - F.length(tail))
    return F.struct(head.alias("head"), F.coalesce(tail.try_cast("bigint"), F.lit(0)).alias("number"))


def first_problem(*rules: tuple[Column, Column | str]) -> Column:
    """The text of the first rule whose condition holds; null if none does."""
    out = None
    for condition, text in rules:
        text = text if isinstance(text, Column) else F.lit(text)
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out
