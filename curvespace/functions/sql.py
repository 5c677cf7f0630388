"""Keys and covers as functions of plain Spark SQL, with bodies that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from curvespace.params import SfcParams


def _cell(v: str, low: float, high: float, p: SfcParams) -> str:
    """SQL of :func:`curvespace.functions.quantize.quantize`."""
    if high <= low or not p.bits:
        return "0L"
    part = f"(CASE WHEN isnan(CAST({v} AS DOUBLE)) THEN {float(low)}D ELSE CAST({v} AS DOUBLE) END - {float(low)}D) / {float(high) - float(low)}D"
    return f"CAST({'floor' if p.floors else 'round'}(greatest(least({part}, 1D), 0D) * {float(2**p.bits - 1)}D) AS BIGINT)"


def _bits(v: str, p: SfcParams, step: int, at: int) -> str:
    return "(" + " + ".join(f"shiftleft(shiftright({v}, {i}) & 1L, {step * i + at})" for i in range(p.bits)) + ")"


def register(spark: SparkSession, p: SfcParams, prefix: str = "sfc") -> None:
    """Define temporary SQL functions for keys of ``p``, which must not be bucketed: ``<prefix>_key(lat, lon, t)``; ``<prefix>_block(x, y, z)``, the key of a cell;
    and the table function ``<prefix>_cover(lat_min, lat_max, lon_min, lon_max, t_start, t_end, block_bits)``, which gives ``lo, hi`` of the ranges of the
    aligned blocks of ``2**block_bits`` keys (a multiple of 3) that meet a window. Bounds may be reversed; time is widened by one cell."""
    if p.bucketed:
        raise ValueError("bucketed keys have no SQL functions")
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} {prefix}_block(x BIGINT, y BIGINT, z BIGINT) RETURNS BIGINT RETURN {_bits('x', p, 3, 2)} + {_bits('y', p, 3, 1)} + {_bits('z', p, 3, 0)}")
    x, y, z = _cell("lat", *p.lat, p), _cell("lon", *p.lon, p), _cell(f"greatest(t, {p.time[0]}L)", *p.time, p)
    spark.sql(f"{make} {prefix}_cells(lat DOUBLE, lon DOUBLE, t BIGINT) RETURNS STRUCT<x: BIGINT, y: BIGINT, z: BIGINT> RETURN named_struct('x', {x}, 'y', {y}, 'z', {z})")
    cell = f"{prefix}_cells(lat, lon, t)"
    spark.sql(f"{make} {prefix}_key(lat DOUBLE, lon DOUBLE, t BIGINT) RETURNS BIGINT RETURN {prefix}_block({cell}.x, {cell}.y, {cell}.z)")
    low, high = f"{prefix}_cells(least(lat_min, lat_max), least(lon_min, lon_max), greatest(least(t_start, t_end) - {p.time_pad}, 0L))", f"{prefix}_cells(greatest(lat_min, lat_max), greatest(lon_min, lon_max), greatest(t_start, t_end) + {max(0, p.time_pad - 1)})"
    axes = " ".join(f"LATERAL VIEW explode(sequence(shiftright(a.{c}, s), shiftright(b.{c}, s))) {c}s AS {c}" for c in "xyz")
    spark.sql(f"""{make} {prefix}_cover(lat_min DOUBLE, lat_max DOUBLE, lon_min DOUBLE, lon_max DOUBLE, t_start BIGINT, t_end BIGINT, block_bits INT) RETURNS TABLE (lo BIGINT, hi BIGINT) RETURN
SELECT min(first) AS lo, max(last) AS hi FROM (
  SELECT first, last, sum(opens) OVER (ORDER BY first) AS run FROM (
    SELECT first, last, CASE WHEN first > lag(last) OVER (ORDER BY first) + 1 THEN 1 ELSE 0 END AS opens FROM (
      SELECT {prefix}_block(shiftleft(x, s), shiftleft(y, s), shiftleft(z, s)) AS first, {prefix}_block(shiftleft(x, s), shiftleft(y, s), shiftleft(z, s)) + shiftleft(1L, 3 * s) - 1 AS last
      FROM (SELECT {low} AS a, {high} AS b, block_bits DIV 3 AS s) box {axes}))) GROUP BY run""")
