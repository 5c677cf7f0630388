"""Points and ranges of keys joined by merging both in the order of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespace.operators.cover import merge_ranges
from curvespace.operators.ranking import scanned


def in_ranges(points: DataFrame, ranges: DataFrame, by: Sequence[str] = ("name",), key: str = "key") -> DataFrame:
    """The rows of ``points`` whose ``key`` lies in one of ``ranges(by, lo, hi)`` of equal ``by``: a semi-join. Rows with a null
    in ``by`` or ``key`` have no range.

    Ranges are merged, so that at most one can hold a key: the last that starts at or before it. Both tables are dealt together by
    quantiles of (``by``, key) and read in that order; the last start seen is handed on from part to part. A group
    that holds a third of all points is cut like any other, and no pair of a point and a range is ever made.
    """
    kinds = {c: points.schema[c].dataType for c in points.columns}
    starts = merge_ranges(ranges.select(*by, "lo", "hi").na.drop(), by)
    own = starts.select(*[(F.col(c) if c in by else F.col("lo") if c == key else F.lit(None)).cast(kinds[c]).alias(c) for c in points.columns], F.struct(*by, "hi").alias("range_"))
    rows = points.na.drop(subset=[*by, key]).withColumn("range_", F.lit(None).cast(own.schema["range_"].dataType)).unionByName(own).withColumn("kind_", F.col("range_").isNull())
    met = scanned(rows, [*by, key, "kind_"], F.col("range_"), "last_", "last")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"last_.{c}"))
    return met.filter(F.col("kind_") & same & (F.col(key) <= F.col("last_.hi"))).select(*points.columns)
