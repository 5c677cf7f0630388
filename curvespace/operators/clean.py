"""Cleaning of raw trajectory points, with the reason why each row goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespace.functions.geo import haversine_m, speed_kmh
from curvespace.functions.timeparse import local_to_utc
from curvespace.sources.shared import keep


@dataclass(frozen=True)
class CleanRules:
    """Bounds and thresholds; time bounds are UTC seconds, half open."""

    zone: str = "Asia/Shanghai"
    time: tuple[int, int] = (1_175_385_600, 1_346_457_600)
    lat: tuple[float, float] = (39.0, 41.0)
    lon: tuple[float, float] = (115.0, 118.0)
    max_kmh: float = 200.0
    min_metres: float = 1.0
    min_seconds: int = 2
    min_points: int = 5


#: In the order in which they are tried.
REASONS = ("bad_format", "zero_coord", "bad_time", "out_of_time", "out_of_bbox", "same_second", "speed", "too_close", "too_short")


def row_reason(rules: CleanRules) -> Column:
    """Why a row goes by itself, given ``lat``, ``lon``, ``date``, ``time``, ``ts`` and ``dt_s``; null if it does not."""
    return (
        F.when(F.col("lat").isNull() | F.col("lon").isNull() | F.col("date").isNull() | F.col("time").isNull(), "bad_format")
        .when((F.col("lat") == 0) & (F.col("lon") == 0), "zero_coord")
        .when(F.col("ts").isNull(), "bad_time")
        .when(~((F.col("dt_s") >= rules.time[0]) & (F.col("dt_s") < rules.time[1])), "out_of_time")
        .when(~(F.col("lat").between(*rules.lat) & F.col("lon").between(*rules.lon)), "out_of_bbox")
    )


def tag(raw: DataFrame, rules: CleanRules = CleanRules(), slice_s: int | None = None) -> DataFrame:
    """``raw(traj_id, ordinal, lat, lon, date, time)`` with ``ts`` (UTC), ``reason`` (null: the row stays), ``dist_m`` and
    ``speed`` from the row before.

    Rows of a trajectory go by time, then ordinal. Of rows equal in second and coordinates the first stays. Speed
    and distance are to the row before, whether or not that row itself was dropped for speed or closeness. A
    trajectory with fewer than ``min_points`` rows left goes whole.

    A trajectory is one task's, with one shuffle. Where one may be too large for that, ``slice_s`` cuts trajectories into pieces of
    so many seconds (rows without a time go by hash): each piece is handed the last row before it, and the rows left are counted by
    piece, then by trajectory. Only a row a piece moves for that; the tagged rows are written to the shared folder once.
    """
    ts = local_to_utc(F.col("date"), F.col("time"), rules.zone)
    rows = raw.withColumn("ts", ts).withColumn("dt_s", F.unix_seconds("ts"))
    by = ["traj_id"]
    if slice_s:
        by = ["traj_id", "piece"]
        rows = rows.withColumn("piece", F.coalesce(F.floor(F.col("dt_s") / slice_s), -(2**40) - F.pmod(F.xxhash64("ordinal"), F.lit(1024))))
    rows = rows.repartition(*by)  # the one shuffle of all rows: windows are within a trajectory or its piece
    rows = rows.withColumn("r1", row_reason(rules))
    same = W.partitionBy(*by, "r1", "dt_s", "lat", "lon").orderBy("ts", "ordinal")
    rows = rows.withColumn("r2", F.coalesce("r1", F.when(F.row_number().over(same) > 1, "same_second")))
    along = W.partitionBy(*by, "r2").orderBy("ts", "ordinal")
    prev = {c: F.lag(c).over(along) for c in ("lat", "lon", "dt_s")}
    if slice_s:
        rows = keep(rows.withColumns({f"{c}_before": v for c, v in prev.items()}))
        last = F.max_by(F.struct("lat", "lon", "dt_s"), F.struct("ts", "ordinal"))
        ends = rows.filter("r2 is null").groupBy(*by).agg(last.alias("last"))  # a row for each piece
        ends = ends.select(F.col("traj_id").alias("traj_"), F.col("piece").alias("piece_"), F.lag("last").over(W.partitionBy("traj_id").orderBy("piece")).alias("last"))
        rows = rows.join(ends, F.col("traj_id").eqNullSafe(F.col("traj_")) & (F.col("piece") == F.col("piece_")), "left")
        prev = {c: F.coalesce(f"{c}_before", f"last.{c}") for c in prev}
    rows = rows.withColumn("gap_s", F.when(F.col("r2").isNull(), F.col("dt_s") - prev["dt_s"]))
    rows = rows.withColumn("dist_m", F.when(F.col("r2").isNull(), haversine_m(prev["lat"], prev["lon"], F.col("lat"), F.col("lon"))))
    rows = rows.withColumn("speed", speed_kmh(F.col("dist_m"), F.col("gap_s")))
    slow = F.when(F.col("speed") > rules.max_kmh, "speed").when((F.col("dist_m") < rules.min_metres) & (F.col("gap_s") < max(rules.min_seconds, 1)), "too_close")
    rows = rows.withColumn("r3", F.coalesce("r2", slow))
    if slice_s:
        rows = rows.drop("traj_", "piece_", "last", *[f"{c}_before" for c in prev])
        counts = rows.groupBy(*by).agg(F.count_if(F.col("r3").isNull()).alias("n"))
        counts = counts.select(F.col("traj_id").alias("traj_"), F.col("piece").alias("piece_"), F.sum("n").over(W.partitionBy("traj_id")).alias("left_"))
        rows = rows.join(counts, F.col("traj_id").eqNullSafe(F.col("traj_")) & (F.col("piece") == F.col("piece_")))
        short = F.col("left_") < rules.min_points
    else:
        short = F.count_if(F.col("r3").isNull()).over(W.partitionBy("traj_id")) < rules.min_points
    return rows.withColumn("reason", F.coalesce("r3", F.when(short, "too_short"))).drop("r1", "r2", "r3", "piece", "traj_", "piece_", "left_")


def kept(tagged: DataFrame) -> DataFrame:
    """The rows that stay."""
    return tagged.filter(F.col("reason").isNull()).drop("reason")


def counters(tagged: DataFrame) -> DataFrame:
    """``reason, n_rows, n_trajectories``; the rows that stay under ``kept``."""
    return tagged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("traj_id").alias("n_trajectories"))


def with_ordinal(points: DataFrame, *order: str) -> DataFrame:
    """``segment_id``: place from 0 of each point in its trajectory, by ``order`` (``ordinal``: the order of arrival)."""
    return points.withColumn("segment_id", (F.row_number().over(W.partitionBy("traj_id").orderBy(*(order or ("ordinal",)))) - 1).cast("int"))
