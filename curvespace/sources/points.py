"""Point tables: views over the test tables, CSV with header aliases, raw PLT files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespace.functions.hashing import trajectory_id
from curvespace.functions.timeparse import parse_seconds

# Column names that a clean CSV may use, in order of preference.
ALIASES = {
    "user": ("user", "uid", "user_id"),
    "traj_id": ("traj_id", "trajectory_id", "tid"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "longitude"),
    "datetime": ("datetime", "time"),
}
REQUIRED = ("lat", "lon", "datetime")


def pts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, traj_id, ordinal, lat, lon, t`` from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        user.alias("user"), user.alias("traj_id"), F.col("event_id").alias("ordinal"),
        (F.lit(39.0) + F.col("value") / 300.0).alias("lat"), (F.lit(115.0) + k * 3.0 / 100.0).alias("lon"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"),
    )


def pts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, traj_id, lat, lon, t`` from ``lineitem``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("user"), F.col("l_orderkey").cast("string").alias("traj_id"),
        (F.lit(39.0) + F.col("l_extendedprice") / 60000.0).alias("lat"), (F.lit(115.0) + F.col("l_suppkey") * 3.0 / 1000.0).alias("lon"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
    )


def resolve(columns: list[str]) -> dict[str, str | None]:
    """The column to read for each field, by case-insensitive alias; required ones raise if there is none."""
    low = {c.lower(): c for c in reversed(columns)}
    found = {f: next((low[a] for a in names if a in low), None) for f, names in ALIASES.items()}
    if missing := [f for f in REQUIRED if found[f] is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def ingest(rows: DataFrame, max_ingest: int | None = None, order: str | None = None) -> DataFrame:
    """Points of a table of strings: ``user, traj_id, traj_hash, lat, lon, t, datetime``, and ``order`` if given. Rows whose coordinates are
    no numbers (or NaN) are skipped; times that cannot be read are 0. ``max_ingest`` rows by ``order``; none or 0:
    all."""
    c = resolve(rows.columns)
    text = lambda f: F.coalesce(F.trim(F.col(c[f])), F.lit("")) if c[f] else F.lit("")
    pts = rows.withColumns({"lat_": F.trim(F.col(c["lat"]).cast("string")).try_cast("double"), "lon_": F.trim(F.col(c["lon"]).cast("string")).try_cast("double")})
    pts = pts.filter(F.col("lat_").isNotNull() & F.col("lon_").isNotNull() & ~F.isnan("lat_") & ~F.isnan("lon_"))
    if max_ingest:
        pts = (pts.orderBy(order) if order else pts).limit(max_ingest)
    return pts.select(
        text("user").alias("user"), text("traj_id").alias("traj_id"), trajectory_id(text("user"), text("traj_id"), text("datetime")).alias("traj_hash"),
        F.col("lat_").alias("lat"), F.col("lon_").alias("lon"), parse_seconds(text("datetime")).alias("t"), text("datetime").alias("datetime"),
        *([F.col(order)] if order else []),
    )


def read_clean_csv(spark: SparkSession, path: str, max_ingest: int | None = None) -> DataFrame:
    """Points of a CSV with a header. Rows are read as they are: what a line lacks is null, and such rows go where
    :func:`ingest` says so; :func:`skipped` counts them. ``place`` orders rows as they stand: by file, block of it and row; a cap
    takes the first."""
    rows = spark.read.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return ingest(rows.withColumn("place", place), max_ingest, "place")


def skipped(rows: DataFrame) -> DataFrame:
    """``n_rows, n_skipped``: rows of a table of strings, and those that :func:`ingest` skips."""
    c = resolve(rows.columns)
    number = lambda f: F.trim(F.col(c[f]).cast("string")).try_cast("double")
    bad = number("lat").isNull() | number("lon").isNull() | F.isnan(number("lat")) | F.isnan(number("lon"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_skipped"))


def numbered_lines(lines: DataFrame, skip: int) -> DataFrame:
    """``path, ordinal, line`` of ``lines(path, block, line)``, rows as the text reader gives them: one block of a file after the other,
    each in its order. ``ordinal`` is the place of the block in its file plus that of the line in the block, so it rises along the
    file, with gaps. The first ``skip`` lines of a file and blank lines are left out."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0  # the block in work and its lines so far
        for b in batches:
            if not b.num_rows:
                continue
            path, block, line = b.columns
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) | (np.diff(block.to_numpy()) != 0)
            first = np.flatnonzero(new)
            at = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
            if last == (path[0].as_py(), block[0].as_py()):
                at[: first[1] if len(first) > 1 else b.num_rows] += done
            last, done = (path[-1].as_py(), block[-1].as_py()), int(at[-1]) + 1
            stay = ~((block.to_numpy() == 0) & (at < skip)) & (pc.utf8_length(pc.utf8_trim_whitespace(line)).to_numpy(zero_copy_only=False) > 0)
            yield pa.RecordBatch.from_arrays([path, pa.array(block.to_numpy() + at), line], names=["path", "ordinal", "line"]).filter(pa.array(stay))

    return lines.mapInArrow(number, "path string, ordinal long, line string")


def read_plt(spark: SparkSession, root: str, header_lines: int = 6) -> DataFrame:
    """``user, traj_id, ordinal, lat, lon, date, time`` of ``root/<user>/Trajectory/*.plt``; a line that lacks fields
    or numbers gives nulls. Files are split by bytes, so many tasks read a large one; ``ordinal`` rises along the file."""
    text = spark.read.text(f"{root}/*/Trajectory/*.plt").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = numbered_lines(text, header_lines)
    part = F.split("line", ",")
    user, stem = F.regexp_extract("path", r"([^/]+)/Trajectory/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.plt$", 1)
    return lines.select(
        user.alias("user"), F.concat(user, F.lit("/"), stem).alias("traj_id"), "ordinal",
        F.get(part, F.lit(0)).try_cast("double").alias("lat"), F.get(part, F.lit(1)).try_cast("double").alias("lon"),
        F.get(part, F.lit(5)).alias("date"), F.get(part, F.lit(6)).alias("time"),
    )


def read_summary_text(spark: SparkSession, paths: str) -> DataFrame:
    """``path, name, value`` of the ``key: value`` lines of summary files; values that are no numbers are null."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("value").contains(":"))
    return rows.select("path", F.trim(F.substring_index("value", ":", 1)).alias("name"), F.regexp_extract("value", r":\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("number"))


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """``pnode_idx, total_count`` of node distribution CSVs; unreadable cells are null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("pnode_idx").try_cast("long").alias("pnode_idx"), F.col("total_count").try_cast("long").alias("total_count"))
