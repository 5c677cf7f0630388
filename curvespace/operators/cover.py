"""Covers: the curve keys that a window can hold, as ranges, for many windows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curvespace.functions.curves import cells, encode, morton2, morton3
from curvespace.operators.ranking import scanned
from curvespace.operators.refine import ranges_of
from curvespace.params import SfcParams, Window
from curvespace.sources.shared import ready

WINDOW_SCHEMA = "name string, lat_min double, lat_max double, lon_min double, lon_max double, t_start long, t_end long"


def windows_frame(spark: SparkSession, windows: Sequence[Window]) -> DataFrame:
    return spark.createDataFrame([(w.name, w.lat_min, w.lat_max, w.lon_min, w.lon_max, w.t_start, w.t_end) for w in windows], WINDOW_SCHEMA)


def boxes(windows: DataFrame, p: SfcParams, *carry: str) -> DataFrame:
    """``name, x0, x1, y0, y1, z0, z1``: the closed box of cells of each window; reversed bounds are swapped, time is
    widened by one cell. Columns ``carry`` come along."""
    def both(a: str, b: str) -> tuple[Column, Column]:
        return F.least(a, b), F.greatest(a, b)

    (la0, la1), (lo0, lo1), (t0, t1) = both("lat_min", "lat_max"), both("lon_min", "lon_max"), both("t_start", "t_end")
    low = cells(p, la0, lo0, F.greatest(t0 - p.time_pad, F.lit(0)))
    high = cells(p, la1, lo1, t1 + max(0, p.time_pad - 1))
    return windows.select("name", *carry, *[c.alias(f"{a}{i}") for i, corner in enumerate((low, high)) for a, c in zip("xyz", corner, strict=True)])


#: Most blocks of one window's cover; windows that need more are covered by coarser blocks.
MAX_BLOCKS = 20_000


def _sides(p: SfcParams, shift: int) -> list[Column]:
    """Blocks of side ``2**shift`` cells that a box of :func:`boxes` meets, along each axis (buckets stay single)."""
    wide = lambda a, s: (F.shiftright(f"{a}1", s) - F.shiftright(f"{a}0", s) + 1).cast("long")
    return [wide("x", shift), wide("y", shift), wide("z", 0 if p.bucketed else shift)]


def block_count(p: SfcParams, shift: int) -> Column:
    """How many blocks of side ``2**shift`` a box meets."""
    x, y, z = _sides(p, shift)
    return x * y * (F.lit(1).cast("long") if p.bucketed and shift >= p.bits else z)


def dealt(windows: DataFrame) -> DataFrame:
    """``windows`` in as many parts as a shuffle has, by name. A table of windows is small, so Spark would leave it in one part, whose
    task then made all blocks."""
    return windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")


def blocks(windows: DataFrame, p: SfcParams, block_bits: int = 6, carry: Sequence[str] = ()) -> DataFrame:
    """``name, carry, block``: the aligned blocks of ``2**block_bits`` keys whose cells meet the window's box.

    ``block_bits`` is a multiple of 3 (of 2 for bucketed keys): a block is then a cube (square) of cells.
    """
    own = _explode(boxes(windows, p, *carry).withColumn("s", F.lit(_shift(p, block_bits))), p, *carry)
    return own.select("name", *carry, F.shiftrightunsigned("lo", block_bits).alias("block"))


def _shift(p: SfcParams, block_bits: int) -> int:
    dims = 2 if p.bucketed else 3
    if block_bits % dims:
        raise ValueError(f"block_bits must be a multiple of {dims}")
    return block_bits // dims


def _explode(boxed: DataFrame, p: SfcParams, *carry: str) -> DataFrame:
    """``name, carry, lo, hi``: the keys of every block of side ``2**s`` that a box meets, ``s`` a column."""
    def axis(df: DataFrame, a: str, shift: str) -> DataFrame:
        return df.withColumn(a, F.explode(F.sequence(F.expr(f"shiftright({a}0, {shift})"), F.expr(f"shiftright({a}1, {shift})"))))

    df = axis(axis(boxed, "x", "s"), "y", "s")
    x, y, z = F.expr("shiftleft(x, s)"), F.expr("shiftleft(y, s)"), F.expr("shiftleft(z, s)")
    if not p.bucketed:
        lo = morton3(x, y, z, p.bits)
        return axis(df, "z", "s").select("name", *carry, lo.alias("lo"), (lo + F.expr("shiftleft(1L, 3 * s)") - 1).alias("hi"))
    # squares as large as the plane are the same for all buckets, so one range holds them all
    whole = F.col("s") >= p.bits
    df = df.withColumn("z", F.explode(F.when(whole, F.array("z0")).otherwise(F.sequence("z0", "z1"))))
    if p.true_hilbert:
        raise ValueError("covers along the Hilbert curve are made by fine_cover")
    lo = F.shiftleft("z", 2 * p.bits) + morton2(x, y, p.bits)
    return df.select("name", *carry, lo.alias("lo"), F.when(whole, F.shiftleft(F.col("z1") + 1, 2 * p.bits) - 1).otherwise(lo + F.expr("shiftleft(1L, 2 * s)") - 1).alias("hi"))


def merge_ranges(ranges: DataFrame, by: Sequence[str] = ("name",), gap: int = 1) -> DataFrame:
    """``by, lo, hi``: ranges that overlap or lie within ``gap`` of each other as one."""
    order = W.partitionBy(*by).orderBy("lo", "hi")
    top = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = ranges.withColumn("new_", F.when(top.isNull() | (F.col("lo") > top + gap), 1).otherwise(0)).withColumn("island_", F.sum("new_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island_").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island_")


def merge_keys(keys: DataFrame, by: Sequence[str] = ("name",), gap: int = 4) -> DataFrame:
    """Single keys (column ``key``) as ranges, joined where they lie within ``gap``."""
    return merge_ranges(keys.select(*by, F.col("key").alias("lo"), F.col("key").alias("hi")), by, gap)


def cover(windows: DataFrame, p: SfcParams, block_bits: int = 6, most: int = MAX_BLOCKS) -> DataFrame:
    """``name, lo, hi``: the disjoint closed key ranges of the blocks that meet each window, of ``2**block_bits`` keys or
    as coarse as at most ``most`` blocks a window demand (so no window's ranges outgrow a task)."""
    fine = _shift(p, block_bits)
    level = F.coalesce(*[F.when(block_count(p, s) <= most, F.lit(s)) for s in range(fine, p.bits)], F.lit(max(fine, p.bits)))
    return merge_ranges(_explode(dealt(boxes(windows, p)).withColumn("s", level), p))


def coalesce_ranges(ranges: DataFrame, prefix_bits: int, total_bits: int, by: Sequence[str] = ("name",)) -> DataFrame:
    """Fewer, wider ranges: within every block of equal first ``prefix_bits`` bits, the hull of what lies there. All
    bits: the ranges as they are."""
    if prefix_bits >= total_bits:
        return ranges.select(*by, "lo", "hi")
    s = total_bits - prefix_bits
    a, b, size = F.shiftright("lo", s), F.shiftright("hi", s), 2**s
    piece = lambda at, lo, hi: F.struct(at.alias("prefix_"), lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    # blocks between a range's first and last are full: they need no row each
    parts = F.when(a == b, F.array(piece(a, lo, hi))).otherwise(
        F.array(piece(a, lo, (a + 1) * size - 1), piece(a + 1, (a + 1) * size, b * size - 1), piece(b, b * size, hi))
    )
    hulls = ranges.select(*by, F.explode(F.filter(parts, lambda r: r["lo"] <= r["hi"])).alias("r_")).groupBy(*by, "r_.prefix_").agg(F.min("r_.lo").alias("lo"), F.max("r_.hi").alias("hi"))
    return merge_ranges(hulls, by)


def best_ranges(ranges: DataFrame, most: int, by: Sequence[str] = ("name",)) -> DataFrame:
    """``by, lo, hi``: at most ``most`` ranges that hold all of ``ranges``, of the least total length there is: of the gaps
    between the merged ranges the ``most`` - 1 widest stay (the first of equals), the others are closed. A group of ``by`` is
    one task's; :func:`union_ranges` has no such bound."""
    merged = merge_ranges(ranges, by)
    line = W.partitionBy(*by).orderBy("lo")
    gap = merged.withColumn("gap_", F.col("lo") - F.lag("hi").over(line))
    wide = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("gap_"), "lo"))
    cut = gap.withColumn("cut_", ((wide < most) & F.col("gap_").isNotNull()).cast("int")).withColumn("run_", F.sum("cut_").over(line))
    return cut.groupBy(*by, "run_").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run_")


def union_ranges(ranges: DataFrame, most: int) -> list[tuple[int, int]]:
    """All ``ranges`` as at most ``most`` disjoint ones of the least total length, on the driver. Ranges are dealt by their
    start; what the ones before reach to is carried over from part to part, and of the gaps only the widest return."""
    starts = scanned(ranges.select("lo", "hi"), ["lo", "hi"], F.col("hi"), "top_", "max", inclusive=False)
    gaps = starts.filter(F.col("lo") > F.col("top_") + 1).select("lo", "top_").orderBy(F.desc(F.col("lo") - F.col("top_")), "lo").limit(max(0, most - 1))
    ends = ranges.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if ends.lo is None:
        return []
    cuts = sorted((r.top_, r.lo) for r in gaps.collect())  # at most `most`
    return list(zip([ends.lo, *[b for _, b in cuts]], [*[a for a, _ in cuts], ends.hi], strict=True))


def fine_cover(windows: DataFrame, p: SfcParams, most: int | None = None, block_bits: int = 0, budget: int = MAX_BLOCKS) -> DataFrame:
    """``name, lo, hi``: a cover by blocks of mixed size, refined breadth first, in at most ``most`` ranges a window.

    One block holds all cells at first. In every round the blocks that lie in the window's box are done at their size, those
    that do not meet it are gone, and those on its border are split, the ones with most keys outside the box first, as long as
    the window's blocks stay within ``budget``; what cannot be split stays whole. Rounds end at blocks of ``2**block_bits`` keys; with 0 and
    room enough the cover is the box, key by key. Windows are dealt to tasks by name, and a task refines few of them at a time
    (:mod:`curvespace.operators.refine`), so its memory does not grow with them. Bucketed keys start from a square for each bucket, or
    from one range where the box holds the plane or more buckets than ``budget``.
    """
    ready(windows.sparkSession)
    corners = [f"{a}{i}" for a in "xyz" for i in (0, 1)]
    own = dealt(boxes(windows, p)).groupBy("name").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in corners])).alias("boxes"))
    return own.mapInArrow(ranges_of(p, _shift(p, block_bits), budget, most), StructType([own.schema["name"], StructField("lo", LongType()), StructField("hi", LongType())]))


def anchor_blocks(windows: DataFrame, p: SfcParams, stop_tail_bits: int = 6) -> DataFrame:
    """``name, lo, hi``: the aligned blocks around the keys of the window's centre and corners at its first second and
    the one before its last."""
    pt = lambda a, b: F.struct(F.expr(a).alias("lat"), F.expr(b).alias("lon"))
    spots = F.array(pt("(lat_min + lat_max) * 0.5", "(lon_min + lon_max) * 0.5"), *[pt(f"lat_{a}", f"lon_{b}") for a in ("min", "max") for b in ("min", "max")])
    rows = windows.withColumn("at", F.explode(spots)).withColumn("t", F.explode(F.array(F.col("t_start"), F.greatest(F.col("t_end") - 1, F.lit(0)))))
    lo = F.shiftleft(F.shiftright(encode(p, F.col("at.lat"), F.col("at.lon"), F.col("t")), stop_tail_bits), stop_tail_bits)
    return rows.select("name", lo.alias("lo"), (lo + (2**stop_tail_bits - 1)).alias("hi"))


def plan_windows(windows: DataFrame, p: SfcParams, block_bits: int = 6, prefix_bits: int | None = None, stop_tail_bits: int = 6) -> DataFrame:
    """Cover, coalesced to ``prefix_bits`` if given, with the anchors' blocks added; disjoint."""
    got = cover(windows, p, block_bits)
    if prefix_bits is not None:
        got = coalesce_ranges(got, prefix_bits, p.ring_bits)
    if stop_tail_bits:
        got = merge_ranges(got.unionByName(anchor_blocks(windows, p, stop_tail_bits)))
    return got


def plan_stats(ranges: DataFrame) -> DataFrame:
    """``name, n_ranges, n_keys``."""
    return ranges.groupBy("name").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_keys"))


def split_wrapping(ranges: DataFrame, top: int) -> DataFrame:
    """A range whose end is below its start as the two that it means on a ring whose last key is ``top``."""
    a = F.struct(F.col("lo"), F.lit(top).cast("long").alias("hi"))
    b = F.struct(F.lit(0).cast("long").alias("lo"), F.col("hi"))
    parts = F.when(F.col("lo") <= F.col("hi"), F.array(F.struct("lo", "hi"))).otherwise(F.array(a, b))
    return ranges.withColumn("r_", F.explode(parts)).withColumn("lo", F.col("r_.lo")).withColumn("hi", F.col("r_.hi")).drop("r_")


def meeting(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """Pairs of rows of ``a(lo, hi, ...)`` and ``b(b_lo, b_hi, ...)`` whose closed ranges of keys meet. Ranges are dealt to the
    aligned blocks of ``2**bits`` keys they touch and joined by block, each pair once: in the first block both touch."""
    each = lambda df, lo, hi, to: df.withColumn(to, F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits))))
    both = each(a, "lo", "hi", "at_").join(each(b, "b_lo", "b_hi", "b_at_"), F.col("at_") == F.col("b_at_"))
    first = F.greatest(F.shiftright("lo", bits), F.shiftright("b_lo", bits))
    return both.filter((F.col("lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("hi")) & (F.col("at_") == first)).drop("at_", "b_at_")


def covered_hours(windows: DataFrame, ranges: DataFrame, p: SfcParams, step: int = 3600) -> DataFrame:
    """``name, n_samples, n_covered``: of times every ``step`` seconds, those whose key at the window's centre is in a
    range."""
    every = windows.withColumn("t", F.explode(F.sequence("t_start", "t_end", F.lit(step).cast("long"))))
    keys = every.select("name", "t", encode(p, (F.col("lat_min") + F.col("lat_max")) * 0.5, (F.col("lon_min") + F.col("lon_max")) * 0.5, F.col("t")).alias("key"))
    r = ranges.select(F.col("name").alias("n_"), "lo", "hi")
    hit = keys.join(r, (F.col("name") == F.col("n_")) & F.col("key").between(F.col("lo"), F.col("hi")), "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    return keys.groupBy("name").agg(F.count(F.lit(1)).alias("n_samples")).join(hit, "name", "left").select("name", "n_samples", F.coalesce("c", F.lit(0)).cast("long").alias("n_covered"))
