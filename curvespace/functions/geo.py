"""Distance and speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p1) * F.cos(p2) * t * t
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def speed_kmh(metres: Column, seconds: Column) -> Column:
    return metres / F.greatest(F.lit(1.0), seconds.cast("double")) * 3.6
