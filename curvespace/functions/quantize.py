"""Quantization of a value within bounds to a cell number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(v: Column, low: float, high: float, bits: int, floor: bool) -> Column:
    """Cell of ``v`` among ``2**bits`` over [low, high]: the fraction, clamped to [0, 1], times ``2**bits - 1``, by
    floor or by rounding half up. Empty bounds and 0 bits give cell 0; values outside go to the edge cells; NaN goes
    to cell 0."""
    if high <= low or bits == 0:
        return F.lit(0).cast("long")
    v = v.cast("double")
    part = (F.when(F.isnan(v), F.lit(float(low))).otherwise(v) - F.lit(float(low))) / F.lit(float(high) - float(low))
    scaled = F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * F.lit(float(2**bits - 1))
    return (F.floor(scaled) if floor else F.round(scaled)).cast("long")


def bucket_of(t: Column, t0: int, bucket_s: int, num_buckets: int) -> Column:
    """Time bucket of ``t``, held within the buckets there are."""
    return F.least(F.floor(F.greatest(t - F.lit(t0), F.lit(0)) / F.lit(bucket_s)), F.lit(num_buckets - 1)).cast("long")
