"""Byte-range algebra on DataFrames of (keys..., start, end): half-open ranges, one row each.

Every operator takes the key columns that separate one drive, image or user from another. Windows are always
partitioned by them; for a key that may hold most of the rows, `width` first merges within cells of the address space, so
that a window gets the cells' few results. Range joins never compare all pairs: both sides are spread over cells
of `width` and joined on (keys, cell), and a pair counts in the first cell that both touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EXTENTS = 65_536
ALIGN = 4096
GAP = 65_536


def clamp(df: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Clip to [low, high); what is empty then goes."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumns({"start": F.greatest("start", col(low)), "end": F.least("end", col(high))}).where("start < end")


def align_out(df: DataFrame, align: int, size: Column | int) -> DataFrame:
    """Start down and end up to multiples of `align`, the end at most `size`."""
    size = size if isinstance(size, Column) else F.lit(size)
    end = F.least("end", size)
    up = end + F.pmod(-end, F.lit(align))
    return df.withColumns({"start": F.col("start") - F.pmod("start", F.lit(align)), "end": F.least(up, size)}).where("start < end")


def shift(df: DataFrame, by: Column) -> DataFrame:
    """Relative to absolute addresses or back."""
    return df.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def _one_per_start(df: DataFrame, keys: list[str]) -> DataFrame:
    """The longest range of each start: ties in the order of a window can't then split an island. Combines on the map side."""
    return df.where("start < end").groupBy(*keys, "start").agg(F.max("end").alias("end"))


def _reach(keys: list[str]) -> tuple[Window, Column]:
    w = Window.partitionBy(*keys).orderBy("start")
    return w, F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))


def _islands(df: DataFrame, keys: list[str], gap: Column | int) -> DataFrame:
    """Unites ranges that touch, overlap or lie less than `gap` apart; starts are distinct in each key."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    w, reach = _reach(keys)
    new = reach.isNull() | ((F.col("start") > reach) & (F.col("start") - reach >= gap))
    numbered = df.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_gap(df: DataFrame, keys: list[str], gap: Column | int = 0, width: int | None = None) -> DataFrame:
    """Union of the ranges of each key; neighbours less than `gap` apart become one. Empty ranges vanish.
    `gap` may be a column that is constant in a key, if it is one of the keys' own columns."""
    df = _one_per_start(df.select(*keys, "start", "end"), keys)
    if width:
        cell = df.withColumn("_cell", F.floor(F.col("start") / width))
        df = _one_per_start(_islands(cell, [*keys, "_cell"], gap).drop("_cell"), keys)
    return _islands(df, keys, gap)


def _fitting_gap(merged: DataFrame, keys: list[str], first: int, floor: int, limit: int) -> DataFrame:
    """(keys, _gap): the first gap of first, 2 max(first, floor), 4 ... under which at most `limit` ranges are left."""
    w, reach = _reach(keys)
    apart = merged.withColumn("_apart", F.col("start") - reach)
    n = F.count("*").over(Window.partitionBy(*keys))
    # for a gap g, as many ranges stay as there are distances of g or more, and one: the (limit)-th largest distance must be below g
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_apart"))
    pivot = apart.withColumn("_n", n).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == F.least(F.lit(max(limit, 1)), F.col("_n")))
    base = max(first, floor) * 2
    doublings = F.greatest(F.lit(0), F.floor(F.log2(F.col("_apart") / F.lit(base))).cast("int") + 1)
    fits = F.col("_n") <= limit
    return pivot.select(*keys, F.when(fits, F.lit(first)).otherwise(F.lit(base) * F.pow(F.lit(2.0), doublings).cast("long")).alias("_gap"))


def normalize(df: DataFrame, keys: list[str], size: Column | int, gap: int = GAP, align: int = ALIGN, limit: int = MAX_EXTENTS, width: int | None = None) -> DataFrame:
    """Align outwards, clamp to size, merge; where more than `limit` ranges are left in a key, the gap doubles until they fit. The
    doubling is solved from the distances, not looped."""
    merged = merge_gap(align_out(df, align, size), keys, gap, width)
    wide = merged.join(_fitting_gap(merged, keys, gap, ALIGN, limit), keys)
    return _islands(wide, [*keys, "_gap"], F.col("_gap")).drop("_gap")


def limit_extents(df: DataFrame, keys: list[str], most: int, width: int | None = None) -> DataFrame:
    """Merge the closest ranges until at most `most` are left in a key, the gap starting at twice GAP; nothing is dropped."""
    merged = merge_gap(df, keys, 0, width)
    count = Window.partitionBy(*keys)
    n = merged.withColumn("_n", F.count("*").over(count))
    few = n.where(F.col("_n") <= max(most, 1)).drop("_n")
    many = n.where(F.col("_n") > max(most, 1)).drop("_n")
    wide = many.join(_fitting_gap(merge_gap(many, keys, 2 * GAP), keys, 2 * GAP, GAP, max(most, 1)), keys)
    return few.unionByName(_islands(wide, [*keys, "_gap"], F.col("_gap")).drop("_gap"))


def complement(df: DataFrame, keys: list[str], bounds: DataFrame, width: int | None = None) -> DataFrame:
    """What the ranges leave free of each key's [low, high) in bounds (keys, low, high), both edges included."""
    merged = merge_gap(df, keys, width=width).join(bounds, keys, "right")
    w = Window.partitionBy(*keys).orderBy("start")
    some = F.col("start").isNotNull()  # a key without ranges is free from low to high
    inside = merged.withColumns({"start": F.when(some, F.least(F.greatest("start", "low"), "high")), "end": F.when(some, F.greatest(F.least("end", "high"), "low"))})
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("low"))
    last = F.lead("start").over(w).isNull()
    inside = inside.withColumns({"_before": before, "_last": last})
    behind = F.when(F.col("_last") & F.col("start").isNotNull(), F.greatest("end", "_before"))
    gaps = F.array(F.struct(F.col("_before").alias("start"), F.coalesce("start", "high").alias("end")), F.struct(behind.alias("start"), F.col("high").alias("end")))
    return inside.select(*keys, F.explode(gaps).alias("_g")).select(*keys, F.col("_g.start").alias("start"), F.col("_g.end").alias("end")).where("start < end")


def _cells(df: DataFrame, width: int, name: str) -> DataFrame:
    first, last = F.floor(F.col(f"{name}start") / width), F.floor((F.col(f"{name}end") - 1) / width)
    return df.withColumn(f"{name}first", first).withColumn("_cell", F.explode(F.sequence(first, last)))


def _spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each range once: what the ranges of a table are told apart by, whatever order its rows come in."""
    return df.select(*keys, "start", "end").distinct()


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """All overlapping pairs: the columns of left, and of right with `r_` before start and end. how: inner, or left_semi or left_anti
    for the left rows that overlap something or nothing."""
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"}).where("r_start < r_end")
    if how in ("left_semi", "left_anti"):
        return left.join(_spans(range_join(_spans(left, keys), right.select(*keys, "start", "end"), keys, width), keys), [*keys, "start", "end"], how).select(*left.columns)
    a, b = _cells(left.where("start < end").withColumnsRenamed({"start": "l_start", "end": "l_end"}), width, "l_"), _cells(r, width, "r_")
    both = a.join(b, [*keys, "_cell"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_cell") == F.greatest("l_first", "r_first")))
    return both.drop("_cell", "l_first", "r_first").withColumnsRenamed({"l_start": "start", "l_end": "end"})


def overlap_sum(ranges: DataFrame, windows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The windows (keys, start, end, ...) with `used`: the bytes of disjoint ranges in each; 0 where there are none."""
    names = [c for c in windows.columns if c not in ("start", "end")]
    pairs = range_join(windows, ranges.select(*keys, "start", "end"), keys, width)
    used = pairs.groupBy(*names, "start", "end").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("used"))
    return windows.join(used, [*names, "start", "end"], "left").withColumn("used", F.coalesce("used", F.lit(0)))


def not_covered(ranges: DataFrame, by: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The ranges that lie within none of `by`."""
    inside = range_join(_spans(ranges, keys), by.select(*keys, "start", "end"), keys, width).where("r_start <= start and end <= r_end")
    return ranges.join(_spans(inside, keys), [*keys, "start", "end"], "left_anti").select(*ranges.columns)


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, previous_end): ranges that begin before an earlier one of their key ends, in order of (start, end)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*keys, "start", "end").where("start < end").withColumn("previous_end", before).where("previous_end > start")


def cut_pieces(df: DataFrame, chunk: int) -> DataFrame:
    """Each range in pieces of at most `chunk`, counted from its own start."""
    at = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(chunk).cast("long")))
    cut = df.where("start < end").withColumn("_at", at)
    return cut.withColumn("end", F.least(F.col("_at") + chunk, F.col("end"))).withColumn("start", F.col("_at")).drop("_at")


def zero_pieces(length: Column, most: int = 64 << 20, least: int = 4096) -> Column:
    """Lengths that a stretch of zeros is cut to: `most` again and again, then the powers of two of what is left down to `least`,
    then the rest."""
    rest = F.pmod(length, F.lit(most))
    powers = [p for p in (1 << k for k in range(62, -1, -1)) if least <= p < most]
    bits = F.filter(F.array(*[F.when(rest.bitwiseAND(F.lit(p)) != 0, F.lit(p).cast("long")) for p in powers]), lambda x: x.isNotNull())
    tail = F.pmod(length, F.lit(least))
    end = F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array_repeat(F.lit(most).cast("long"), F.floor(length / most).cast("int")), bits, end)


def remap(ranges: DataFrame, segments: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Ranges of one address space in another, through segments (keys, start, end, target): one row for each segment touched."""
    pairs = range_join(ranges, segments, keys, width)
    start, end = F.greatest("start", "r_start"), F.least("end", "r_end")
    to = F.col("target") + start - F.col("r_start")
    return pairs.withColumn("_to", to).withColumn("_len", end - start).drop("r_start", "r_end", "target").withColumn("start", F.col("_to")).withColumn("end", F.col("_to") + F.col("_len")).drop("_to", "_len")


def locate(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Points with the range around them (r_start, r_end and the other columns of ranges), for points that have one."""
    p = points.withColumn("start", F.col(at)).withColumn("end", F.col(at) + 1)
    return range_join(p, ranges, keys, width).drop("start", "end")


def overlay(patches: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Ranges that hide each other, a larger `order` on top: the visible stretches (keys, start, end, order). Each stretch between
    neighbouring edges goes to the largest order that covers it; a range join finds those that do."""
    p = patches.where("start < end").select(*keys, "start", "end", order)
    edges = p.select(*keys, F.explode(F.array("start", "end")).alias("start")).distinct()
    w = Window.partitionBy(*keys).orderBy("start")
    stretches = edges.withColumn("end", F.lead("start").over(w)).where(F.col("end").isNotNull())
    return range_join(stretches, p, keys, width).groupBy(*keys, "start", "end").agg(F.max(order).alias(order))
