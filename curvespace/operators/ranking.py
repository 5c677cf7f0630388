"""Global places and running values of rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespace.sources.shared import keep


def with_place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: its row's place from 0 by ``order``. Rows are dealt into ranges, numbered within them,
    and the ranges' counts (one row a partition) are summed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()))
    counts = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    base = counts.select(F.col("range_").alias("r_"), (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("base_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn(name, within.cast("long")).join(base, F.col("range_") == F.col("r_")).withColumn(name, F.col(name) + F.col("base_")).drop("range_", "r_", "base_")


_OVER = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def scanned(df: DataFrame, order: list[str], value: Column, name: str, how: str = "last", inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: over the rows up to its own (or only before it) by ``order``, the greatest ``value``, their sum, or the
    last one that is not null; null where there is none. Rows of equal ``order`` see each other in any order.

    Rows are dealt into ranges of ``order``; each range hands one value on, so a group that a third of the rows share is split
    like any other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own, at, carried = (f"{name}{x}" for x in ("part_", "own_", "at_", "carried_"))
    ranged = keep(df.withColumn(own, value).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    end = F.max_by(own, F.when(F.col(own).isNotNull(), F.struct(*order))) if how == "last" else _OVER[how](F.col(own))
    ends = ranged.groupBy(F.col(part).alias(at)).agg(end.alias(carried))  # a row for each partition
    before = ends.withColumn(carried, _OVER[how](F.col(carried)).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)))
    line = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = ranged.withColumn(name, _OVER[how](F.col(own)).over(line)).join(F.broadcast(before), F.col(part) == F.col(at))
    both = {"max": F.greatest(name, carried), "sum": F.coalesce(F.col(name) + F.col(carried), name, carried), "last": F.coalesce(name, carried)}
    return rows.withColumn(name, both[how]).select(*df.columns, name)
