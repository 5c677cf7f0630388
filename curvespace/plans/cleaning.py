"""Cleaning end to end: a folder of raw trajectory files to a clean table and the account of what went."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespace.functions.timeparse import iso_utc
from curvespace.operators.clean import REASONS, CleanRules, kept, tag
from curvespace.plans.analytics import output_bounds
from curvespace.sources.points import read_plt
from curvespace.sources.shared import keep

# The summary's name for the rows that go for each reason.
COUNTERS = {
    "bad_format": "rows_bad_format", "bad_time": "rows_bad_time", "zero_coord": "rows_zero_coord", "out_of_bbox": "rows_out_of_bbox", "out_of_time": "rows_out_of_timerange",
    "same_second": "rows_same_second_merged", "speed": "rows_speed_outlier", "too_close": "rows_too_close",
}


def account(tagged: DataFrame) -> DataFrame:
    """One row with the eleven counters of a cleaning run over ``tagged`` (see :func:`clean.tag`): files (a trajectory
    each), rows, rows dropped for each reason, trajectories that had rows left before the last rule, and those of them
    that were too short."""
    assert set(COUNTERS) | {"too_short"} == set(REASONS)
    reason = F.col("reason")
    late = F.coalesce(reason, F.lit("")).isin("", "too_short", "speed", "too_close")  # reached the last rules
    each = tagged.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(reason == r).alias(n) for r, n in COUNTERS.items()],
        F.max(late).alias("reached"), F.max(F.coalesce(reason, F.lit("kept")) == "kept").alias("kept"),
    )
    return each.agg(
        F.count(F.lit(1)).alias("files_total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_total"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTERS.values()],
        F.count_if("reached").alias("traj_total"), F.count_if(F.col("reached") & ~F.col("kept")).alias("traj_too_short"),
    )


def clean_table(tagged: DataFrame) -> DataFrame:
    """``user, traj_id, lat, lon, datetime`` of the rows that stay."""
    return kept(tagged).select("user", "traj_id", "lat", "lon", iso_utc(F.col("ts")).alias("datetime"))


def observed(tagged: DataFrame, name: str = "account") -> tuple[DataFrame, Observation]:
    """``tagged`` and an observation that has the account (see :func:`account`) and the bounds of what stays once an action has read
    all of it. ``tagged`` lies by trajectory, so what concerns whole trajectories is marked on their first row without a shuffle."""
    own, line = W.partitionBy("traj_id"), W.partitionBy("traj_id").orderBy("ordinal")
    reason = F.col("reason")
    late = F.coalesce(reason, F.lit("")).isin("", "too_short", "speed", "too_close")
    marked = tagged.withColumns({"first_": F.row_number().over(line) == 1, "reached_": F.max(late).over(own), "kept_": F.max(reason.isNull()).over(own)})
    seen, count = Observation(name), lambda c, n: F.count_if(c).alias(n)
    bounds = [f(F.when(reason.isNull(), F.col(c))).alias(f"{c}_{n}") for c in ("lat", "lon", "ts") for n, f in (("min", F.min), ("max", F.max))]
    rows = marked.observe(
        seen, count(F.col("first_"), "files_total"), F.count(F.lit(1)).alias("rows_total"), *[count(reason == r, n) for r, n in COUNTERS.items()],
        count(F.col("first_") & F.col("reached_"), "traj_total"), count(F.col("first_") & F.col("reached_") & ~F.col("kept_"), "traj_too_short"), *bounds,
    )
    return rows.drop("first_", "reached_", "kept_"), seen


def clean_folder(spark: SparkSession, root: str, out: str, rules: CleanRules = CleanRules(), kind: str = "csv", slice_s: int | None = None) -> DataFrame:
    """Clean ``root/<user>/Trajectory/*.plt`` into ``out/clean`` (CSV with header, or Parquet) and ``out/summary`` (a line
    for each counter and bound, as text); the summary's row comes back. One job reads the raw files and writes the table; the
    account is observed on the way. With ``slice_s`` (see :func:`clean.tag`) trajectories are cut, and the tagged rows are
    written down first."""
    tagged = tag(read_plt(spark, root), rules, slice_s)
    if slice_s:
        tagged = keep(tagged)
        summary = keep(account(tagged).crossJoin(F.broadcast(output_bounds(kept(tagged)))))  # a row each
    else:
        tagged, seen = observed(tagged)
    table = clean_table(tagged)
    (table.write.option("header", True).csv if kind == "csv" else table.write.parquet)(f"{out}/clean")
    if not slice_s:
        kinds = {"lat": "double", "lon": "double", "ts": "timestamp"}
        got = seen.get
        summary = spark.createDataFrame([tuple(got.values())], ", ".join(f"{c} {kinds.get(c.rsplit('_', 1)[0], 'long')}" for c in got))
    lines = F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns]))
    summary.select(lines).write.text(f"{out}/summary")
    return summary
