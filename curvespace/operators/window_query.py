"""Window queries: the exact box for the answer, blocks of keys for many windows, and the cost of fetching it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespace.functions.curves import encode
from curvespace.operators.cover import block_count, blocks, boxes, dealt, meeting, merge_ranges, plan_windows
from curvespace.operators.placement import spacing
from curvespace.operators.range_join import in_ranges
from curvespace.operators.routing import hops
from curvespace.params import Placement, SfcParams, Window
from curvespace.sources.shared import keep

#: Most ranges put into one filter, and most rows of a table that goes to all tasks.
MAX_RANGES, MAX_ROWS = 100, 100_000

#: Bounds of a window.
LIMITS = ("lat_min", "lat_max", "lon_min", "lon_max", "t_start", "t_end")

#: Blocks a window on average, up to which blocks are refined for tables of windows that do not go to all tasks.
DEALT = 64


def inside(w: Window) -> Column:
    """The exact box: closed in latitude, longitude and time."""
    return F.col("lat").between(w.lat_min, w.lat_max) & F.col("lon").between(w.lon_min, w.lon_max) & F.col("t").between(w.t_start, w.t_end)


def window_query(points: DataFrame, w: Window) -> DataFrame:
    """The points of a window, by the exact box. Over stored coordinates it reaches the scan; keys that would have to be computed
    prune nothing. A table that stores its keys is read by :class:`curvespace.sources.keyed_store.KeyedStore`."""
    return points.filter(inside(w))


def grid(windows: DataFrame, p: SfcParams) -> tuple[int, bool]:
    """The side of the blocks for :func:`multi_window`, as a power of 2 in cells, and whether the table of windows and blocks goes to all
    tasks. It does where blocks as fine as ``MAX_ROWS`` rows allow will do; of more windows than ``MAX_ROWS / DEALT`` it may have
    ``DEALT`` rows a window, else many windows would share few large blocks and meet all points in them."""
    levels = range(2, p.bits + 1)
    sums = boxes(windows, p).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(block_count(p, s)), F.lit(0)).alias(f"n{s}") for s in levels]).first()
    s = next((s for s in levels if sums[f"n{s}"] <= max(MAX_ROWS, DEALT * sums.n)), p.bits)
    return s, sums[f"n{s}"] <= MAX_ROWS


def multi_window(points: DataFrame, windows: DataFrame, p: SfcParams) -> DataFrame:
    """``name`` and the points of each of many windows. Windows are dealt to the blocks of cells that they meet and joined
    with the points by block (:func:`grid`); the exact box decides. Tables of windows and blocks of over ``MAX_ROWS`` rows are dealt by
    block, like the points."""
    s, small = grid(windows, p)
    bits = (2 if p.bucketed else 3) * s
    bounds = windows.select("name", *LIMITS)
    bounds = bounds if small else dealt(bounds)
    if p.bucketed and s >= p.bits:  # whole planes: the exact box alone decides
        side, own = bounds.withColumn("block", F.lit(0).cast("long")), F.lit(0).cast("long")
    else:
        side, own = blocks(bounds, p, bits, LIMITS), F.shiftright(encode(p, F.col("lat"), F.col("lon"), F.col("t")), bits)
    side = side.withColumnsRenamed({c: f"w_{c}" for c in LIMITS})
    side = F.broadcast(side) if small else side
    on = F.col("lat").between(F.col("w_lat_min"), F.col("w_lat_max")) & F.col("lon").between(F.col("w_lon_min"), F.col("w_lon_max")) & F.col("t").between(F.col("w_t_start"), F.col("w_t_end"))
    return points.join(side, (own == F.col("block")) & on).select("name", *points.columns)


def fetch(placed: DataFrame, windows: DataFrame, plan: DataFrame, p: SfcParams, key: str = "key") -> DataFrame:
    """``name`` and the points of each window, as the nodes of ``plan`` (see :func:`fetch_plan`) return them: of what a
    planned node holds, the points inside the box whose key lies in one of the node's ranges. Plans of up to ``MAX_ROWS`` ranges go to
    all tasks; larger ones are merged with the points in the order of keys (:func:`curvespace.operators.range_join.in_ranges`)."""
    return _planned(multi_window(placed, windows, p), plan, key)


def _planned(found: DataFrame, plan: DataFrame, key: str = "key") -> DataFrame:
    slices = plan.select(F.col("name").alias("n_"), F.col("vnode_idx").alias("v_"), "lo", "hi")
    if slices.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        return in_ranges(found, plan.select("name", "vnode_idx", "lo", "hi"), ("name", "vnode_idx"), key)
    on = (F.col("name") == F.col("n_")) & (F.col("vnode_idx") == F.col("v_")) & F.col(key).between(F.col("lo"), F.col("hi"))
    return found.join(F.broadcast(slices), on, "left_semi")


def distinct_hits(hits: DataFrame, by: tuple[str, ...] = ("traj_id", "segment_id", "key")) -> DataFrame:
    """``name, distinct_hits``: different points of each window."""
    return hits.groupBy("name").agg(F.countDistinct(*by).alias("distinct_hits"))


def fetch_plan(ranges: DataFrame, place: Placement, ring_bits: int) -> DataFrame:
    """``name, pnode_idx, vnode_idx, lo, hi``: what of the ranges each node of a uniform ring holds, merged per virtual
    node. A range reaches the nodes from its first key's to its last key's, by arithmetic; no join."""
    n = place.nodes * (place.vnodes if place.mode == "vnode" else 1)
    s = spacing(n, ring_bits)
    node = lambda k: F.least(F.floor((k + F.lit(s - 1)) / F.lit(s)), F.lit(n)).cast("long")
    parts = ranges.withColumn("i_", F.explode(F.sequence(node(F.col("lo")), node(F.col("hi")))))
    first = F.when(F.col("i_") == 0, F.lit(0)).otherwise((F.col("i_") - 1) * s + 1)
    last = F.when(F.col("i_") == n, F.lit(2**62)).otherwise(F.col("i_") * s)
    cut = parts.select("name", (F.col("i_") % n).alias("vnode_idx"), F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi"))
    return merge_ranges(cut, ("name", "vnode_idx")).select("name", (F.col("vnode_idx") % place.nodes).alias("pnode_idx"), "vnode_idx", "lo", "hi")


def fetch_plan_on(ranges: DataFrame, ring: DataFrame, ring_bits: int) -> DataFrame:
    """The same on any ring whose nodes' ranges do not wrap; nodes and ranges are joined by blocks of keys."""
    r = ring.select("pnode_idx", "vnode_idx", F.col("resp_start").alias("b_lo"), F.col("resp_end").alias("b_hi"))
    met = meeting(ranges.select("name", "lo", "hi"), r, max(0, ring_bits - 13))
    cut = met.select("name", "pnode_idx", "vnode_idx", F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"))
    return merge_ranges(cut, ("name", "pnode_idx", "vnode_idx"))


def pnode_report(plan: DataFrame, hits: DataFrame, place: Placement, ring_bits: int) -> DataFrame:
    """``name, pnode_idx, returned_count, route_hops`` of every planned node; ``hits`` has the windows' points with
    ``name`` and ``pnode_idx``. One route per node, from node 0 to its least planned key; packed rings are not
    uniform, so their hops are null."""
    n = place.nodes * (place.vnodes if place.mode == "vnode" else 1)
    route = F.lit(None).cast("long") if place.mode == "snode" else hops(F.col("key"), n, ring_bits)
    planned = plan.groupBy("name", "pnode_idx").agg(F.min("lo").alias("key")).withColumn("route_hops", route)
    found = hits.groupBy(F.col("name").alias("n_"), F.col("pnode_idx").alias("p_")).agg(F.count(F.lit(1)).alias("c_"))
    rows = planned.join(found, (F.col("name") == F.col("n_")) & (F.col("pnode_idx") == F.col("p_")), "left")
    return rows.select("name", "pnode_idx", F.coalesce("c_", F.lit(0)).cast("long").alias("returned_count"), "route_hops")


def window_report(placed: DataFrame, windows: DataFrame, p: SfcParams, place: Placement) -> DataFrame:
    """:func:`pnode_report` of many windows on a uniform ring, by :func:`fetch`, of which only numbers are kept. Windows of equal bounds
    are one box, and points of equal place, time and node are one row with their number: boxes are planned and meet rows once, what
    they find is counted by key before it is held against the plan, and names come last."""
    named = keep(windows.select("name", *LIMITS))
    boxes = keep(named.select(*LIMITS).distinct().withColumn("name", F.monotonically_increasing_id()))
    plan = keep(fetch_plan(plan_windows(boxes, p), place, p.ring_bits))
    spots = placed.groupBy("lat", "lon", "t", "key", "pnode_idx", "vnode_idx").agg(F.count(F.lit(1)).alias("n_points"))
    found = keep(multi_window(spots, boxes, p).groupBy("name", "pnode_idx", "vnode_idx", "key").agg(F.sum("n_points").alias("n_points")))
    counts = _planned(found, plan).groupBy("name", "pnode_idx").agg(F.sum("n_points").alias("n_points"))
    rows = plan.groupBy("name", "pnode_idx").agg(F.min("lo").alias("key")).join(counts, ["name", "pnode_idx"], "left").withColumnRenamed("name", "box")
    of = boxes.select(F.col("name").alias("box"), *[F.col(c).alias(f"b_{c}") for c in LIMITS])
    on = F.lit(True)
    for c in LIMITS:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    each = named.join(of, on).select("name", "box").join(rows, "box").groupBy("name", "pnode_idx").agg(F.min("key").alias("key"), F.sum("n_points").alias("n_points"))
    n = place.nodes * (place.vnodes if place.mode == "vnode" else 1)
    returned = F.coalesce(F.when(F.col("name").isNotNull(), F.col("n_points")), F.lit(0))  # no point has a null for its window's name
    return each.select("name", "pnode_idx", returned.cast("long").alias("returned_count"), hops(F.col("key"), n, p.ring_bits).alias("route_hops"))


def query_summary(report: DataFrame) -> DataFrame:
    """``name, total_hits, hit_pnodes, total_hops, avg_hops``; hops of packed rings stay null."""
    return report.groupBy("name").agg(
        F.sum("returned_count").alias("total_hits"), F.count(F.lit(1)).alias("hit_pnodes"), F.sum("route_hops").alias("total_hops"), F.round(F.avg("route_hops"), 3).alias("avg_hops")
    )


__all__ = ["MAX_RANGES", "MAX_ROWS", "distinct_hits", "fetch", "fetch_plan", "fetch_plan_on", "inside", "multi_window", "plan_windows", "pnode_report", "query_summary", "window_query", "window_report"]
