"""Streams of points: encoding and placement are stateless, load by node and time is a watermarked aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespace.functions.curves import encode
from curvespace.operators.placement import assign
from curvespace.params import Placement, SfcParams


def encode_stream(points: DataFrame, p: SfcParams, place: Placement) -> DataFrame:
    """``points(lat, lon, t)`` of a stream with ``key`` and node; packed placement needs all keys and is refused."""
    if place.mode == "snode":
        raise ValueError("packed placement needs all keys at once")
    return assign(points.withColumn("key", encode(p, F.col("lat"), F.col("lon"), F.col("t"))), p, place)


def load_by_time(placed: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window, pnode_idx, n``: points per node and time window; rows later than ``late`` are dropped."""
    timed = placed.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "pnode_idx").agg(F.count(F.lit(1)).alias("n"))
