"""A table of placed points by node and bucket of keys, with a manifest of its files."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespace.operators.cover import fine_cover, meeting, union_ranges, windows_frame
from curvespace.operators.placement import bucket_start
from curvespace.operators.window_query import MAX_RANGES, inside, multi_window
from curvespace.params import SfcParams, Window
from curvespace.sources.shared import keep


def between_any(key: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(key).between(lo, hi) for lo, hi in ranges], F.lit(False))


class KeyedStore:
    """``path/points``: Parquet in a folder for each batch and node, sorted by key, with ``bucket``, the first key of a row's
    storage bucket. ``path/manifest``: a row for each file with its node, least and greatest key and its rows.

    A batch counts once its files stand in the manifest, which is written last; what a failed write leaves behind is never read.
    Readers join the ranges they want with the manifest and open only the files that meet one; the names of these
    files are all that comes to the driver, as with any read of Parquet. Batches are added, never changed.
    """

    def __init__(self, spark: SparkSession, path: str, p: SfcParams, tail_bits: int = 6):
        self.spark, self.path, self.p, self.tail_bits = spark, path, p, tail_bits

    def append(self, points: DataFrame, node: str = "pnode_idx", key: str = "key", files: int | None = None) -> KeyedStore:
        """Add ``points``, dealt into about ``files`` files by node and key. Their ``key`` and ``node`` are called ``key`` and
        ``pnode_idx`` here; rows without a key are left out, since no window can hold them."""
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = points.withColumnsRenamed({key: "key", node: "pnode_idx"}).filter("key IS NOT NULL").withColumn("bucket", bucket_start(F.col("key"), self.tail_bits))
        own = own.select(*[c for c in own.columns if c != "pnode_idx"], "pnode_idx")  # the folders' column comes last
        batch = f"{self.path}/points/batch={uuid.uuid4().hex}"
        order = ["pnode_idx", "key"]
        own.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("pnode_idx").parquet(batch)
        own.limit(0).write.mode("ignore").parquet(f"{self.path}/columns")
        made = self.spark.read.schema(own.schema).parquet(batch).groupBy(F.col("_metadata.file_path").alias("file"), "pnode_idx")
        made.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{self.path}/manifest")
        return self

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("file string, pnode_idx long, min_key long, max_key long, rows long").parquet(f"{self.path}/manifest")

    def open(self, files: DataFrame) -> DataFrame:
        """The rows of ``files(file)``."""
        names = sorted(unquote(r.file) for r in files.select("file").distinct().collect())
        like = self.spark.read.parquet(f"{self.path}/columns")
        return self.spark.read.schema(like.schema).option("basePath", f"{self.path}/points").parquet(*names).drop("batch") if names else like

    def table(self) -> DataFrame:
        """All rows of the batches that count."""
        return self.open(self.manifest())

    def meeting(self, ranges: DataFrame) -> DataFrame:
        """The manifest's rows whose keys meet one of ``ranges(lo, hi)``; with a column ``pnode_idx``, one of the same node."""
        m = self.manifest().select("file", F.col("pnode_idx").alias("node_"), F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"))
        met = meeting(ranges.select("lo", "hi", *[c for c in ranges.columns if c == "pnode_idx"]), m, max(0, self.p.ring_bits - 13))
        return (met.filter(F.col("pnode_idx") == F.col("node_")) if "pnode_idx" in ranges.columns else met).select("file", F.col("node_").alias("pnode_idx")).distinct()

    def read(self, ranges: DataFrame, most: int = MAX_RANGES) -> DataFrame:
        """The rows of the files that meet ``ranges``, filtered by at most ``most`` ranges that hold them all; these reach the
        Parquet scan, where they leave out row groups."""
        ranges = keep(ranges)  # made once, read twice
        return self.open(self.meeting(ranges)).filter(between_any("key", union_ranges(ranges, most)))

    def window(self, w: Window) -> DataFrame:
        """The points of a window."""
        ranges = fine_cover(windows_frame(self.spark, [w]), self.p, MAX_RANGES, 2 if self.p.bucketed else 3)
        return self.read(ranges).filter(inside(w))

    def windows(self, windows: DataFrame) -> DataFrame:
        """``name`` and the points of many windows."""
        return multi_window(self.read(fine_cover(windows, self.p, MAX_RANGES, 4 if self.p.bucketed else 6)), windows, self.p)

    def node(self, node: int) -> DataFrame:
        """All rows of a node in the order of buckets; only its files are opened."""
        return self.open(self.manifest().filter(F.col("pnode_idx") == node)).filter(F.col("pnode_idx") == node).orderBy("bucket", "key")

    def buckets(self, lo: int, hi: int) -> DataFrame:
        """Rows of the whole storage buckets that meet [lo, hi]."""
        b = 2**self.tail_bits
        first = lo // b * b
        ranges = self.spark.createDataFrame([(first, hi // b * b + b - 1)], "lo long, hi long")
        return self.open(self.meeting(ranges)).filter(F.col("bucket").between(first, hi))
