"""Placement of keys on a ring of nodes, and what each node then holds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespace.operators.ranking import with_place
from curvespace.params import Placement, SfcParams
from curvespace.sources.shared import file_system, keep

#: Different keys in a row group, which one search of the packing reads.
RUNS = 1 << 16


def spacing(n: int, ring_bits: int) -> int:
    """Distance between neighbours on a uniform ring of ``n`` nodes."""
    return 2**ring_bits // n


def successor(key: Column, n: int, ring_bits: int) -> Column:
    """First node at or after a key on a uniform ring; past the last node, node 0."""
    s = spacing(n, ring_bits)
    i = F.floor((key + F.lit(s - 1)) / F.lit(s)).cast("long")
    return F.when(i >= n, F.lit(0)).otherwise(i).cast("long")


def ring(spark: SparkSession, place: Placement, ring_bits: int) -> DataFrame:
    """``pnode_idx, vnode_idx, node_id, resp_start, resp_end, wrapped`` of a uniform ring; virtual node v belongs to
    node v mod P. Node 0 answers for what lies past the last id, too, so its range wraps."""
    n = place.nodes * (place.vnodes if place.mode == "vnode" else 1)
    s = spacing(n, ring_bits)
    idx = F.col("id")
    return spark.range(n).select(
        (idx % place.nodes).alias("pnode_idx"), idx.alias("vnode_idx"), (idx * s).alias("node_id"),
        F.when(idx == 0, F.lit((n - 1) * s + 1)).otherwise((idx - 1) * s + 1).alias("resp_start"), (idx * s).alias("resp_end"), (idx == 0).alias("wrapped"),
    )


@dataclass
class Packing:
    """Contiguous packing of runs of equal keys: places where nodes end, found run by run in the order of keys.

    ``low`` and ``high`` are the rows that a node should have at least and at most. A node takes whole runs until it has
    ``low``; a run that would lead past ``high`` meanwhile is cut there. Then it takes one run more if that fits into
    ``high``, else what fits of it, and one row at least. The last node takes all that is left. Between two calls of
    :meth:`take` runs may be left out that end before ``wanted``.
    """

    nodes: int
    low: int
    high: int
    start: int = 0
    full: int | None = None  # where the node in work reached ``low``, once it has
    ends: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, nodes: int, total: int, low_ratio: float, high_ratio: float) -> Packing:
        mean = total / nodes
        return cls(nodes, max(1, math.floor(mean * low_ratio)), math.ceil(mean * high_ratio))

    @property
    def wanted(self) -> int:
        """The first run that ends here or later decides next."""
        return self.start + min(self.low, self.high) if self.full is None else self.full + 1

    def take(self, runs: np.ndarray) -> None:
        """Go on with runs that end before the places ``runs`` (rising)."""
        while len(runs) and len(self.ends) < self.nodes:
            if self.full is None:
                at = int(np.searchsorted(runs, self.start + min(self.low, self.high)))
                if at == len(runs):
                    return
                reached = int(runs[at])
                if reached > self.start + self.high or self.high < self.low:
                    self.close(self.start + self.high)
                    continue
                self.full = reached
            at = int(np.searchsorted(runs, self.full, "right"))
            if at == len(runs):
                return
            after = int(runs[at])
            self.close(after if after <= self.start + self.high else max(self.full + 1, self.start + self.high))

    def close(self, end: int) -> None:
        self.ends.append(end)
        self.start, self.full = end, None


class RunEnds:
    """Places where runs of equal keys end, rising, in Parquet files whose row groups are searched by their statistics.

    ``files`` are ``(URI, greatest place)`` in order; the places in a file count from the end of the file before. A search
    opens the footer of one file and reads one of its row groups, so memory is a row group and the footer in hand.
    """

    def __init__(self, files: list[tuple[str, int]]):
        self.names = [name for name, _ in files]
        self.lasts = np.cumsum([last for _, last in files], dtype=np.int64)
        self.open: tuple[int, pq.ParquetFile, np.ndarray] | None = None
        self.reads = 0

    @property
    def total(self) -> int:
        return int(self.lasts[-1]) if len(self.lasts) else 0

    def group(self, place: int) -> np.ndarray | None:
        """The row group that holds the first end at or after ``place``; None past the last one."""
        i = int(np.searchsorted(self.lasts, place))
        if i == len(self.lasts):
            return None
        base = int(self.lasts[i - 1]) if i else 0
        if self.open is None or self.open[0] != i:
            if self.open is not None:
                self.open[1].close()
            fs, path = file_system(self.names[i])
            file = pq.ParquetFile(fs.open_input_file(path))
            at = file.schema_arrow.names.index("end")
            tops = [file.metadata.row_group(g).column(at).statistics.max for g in range(file.num_row_groups)]
            self.open = i, file, np.array(tops, np.int64)
        _, file, tops = self.open
        self.reads += 1
        return file.read_row_group(int(np.searchsorted(tops, place - base)), columns=["end"]).column(0).to_numpy() + base


def run_ends(keys: DataFrame, key: str = "key") -> DataFrame:
    """``part, end``: for every different key, in order within the ranges ``part``, the rows of the range up to the end of that
    key's. Written to the shared folder, a file a range, in row groups of ``RUNS`` rows."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keys.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            end = done + np.cumsum(b.column(1).to_numpy())
            done = int(end[-1]) if len(end) else done
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(end, pa.int64())], names=["part", "end"])

    ranged = counts.repartitionByRange(n, "key").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), "n")
    return keep(ranged.mapInArrow(running, "part int, end long"), options={"parquet.block.row.count.limit": RUNS})


def packed_ends(keys: DataFrame, place: Placement, key: str = "key") -> list[int]:
    """The places, in the order of keys, before which the nodes of a packed placement end; nodes after the last full one
    take no row or what is left. At most ``place.nodes`` numbers.

    A node's end depends on the one before, so one task finds them, but it reads no more than the row groups that hold the
    two ends a node looks for: its work grows with the nodes, and the number of jobs with nothing.
    """
    ends = run_ends(keys, key)
    files = ends.groupBy("part", F.col("_metadata.file_path").alias("file")).agg(F.max("end").alias("last"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = sorted(row for b in batches for row in b.itertuples(index=False, name=None))
        runs = RunEnds([(file, last) for _, file, last in files])
        state = Packing.of(place.nodes, runs.total, place.low_ratio, place.high_ratio)
        while len(state.ends) < state.nodes and (group := runs.group(state.wanted)) is not None:
            state.take(group)
        yield pd.DataFrame({"end": np.array(state.ends, np.int64)})

    return [r.end for r in files.coalesce(1).mapInPandas(walk, "end long").collect()]


def assign(points: DataFrame, p: SfcParams, place: Placement, order: list[Column] | None = None, key: str = "key") -> DataFrame:
    """``points`` with ``pnode_idx`` and ``vnode_idx``.

    ``snode`` packs contiguous key ranges by both ratios of the mean load (:class:`Packing`): whole runs of equal keys
    stay together as far as the upper ratio lets them. Where a run is cut, its rows go by ``order``. A row finds its node
    by its place: nodes, cut at multiples of the mean load, are twice their number at most and go to all tasks.
    """
    if place.mode == "snode":
        spark = points.sparkSession
        ranked = with_place(points, [F.col(key), *(order or [])], "place_")
        total = ranked.count()
        ends = packed_ends(ranked, place, key)
        firsts = [0, *ends[: place.nodes - 1]]
        lasts = [*firsts[1:], total]
        step = max(1, -(-total // place.nodes))
        cut = [(b, k, x, y) for k, (x, y) in enumerate(zip(firsts, lasts, strict=True)) for b in range(x // step, (y - 1) // step + 1) if x < y]
        nodes = spark.createDataFrame(cut, "block_ long, node_ long, from_ long, to_ long")
        on = (F.floor(F.col("place_") / step) == F.col("block_")) & (F.col("place_") >= F.col("from_")) & (F.col("place_") < F.col("to_"))
        return ranked.join(F.broadcast(nodes), on).select(*points.columns, F.col("node_").alias("pnode_idx"), F.col("node_").alias("vnode_idx"))
    n = place.nodes * (place.vnodes if place.mode == "vnode" else 1)
    v = successor(F.col(key), n, p.ring_bits)
    return points.withColumn("vnode_idx", v).withColumn("pnode_idx", F.col("vnode_idx") % place.nodes)


def snode_ring(placed: DataFrame, place: Placement, key: str = "key") -> DataFrame:
    """The ring that packing made: a node's id is its last key, its range starts where the one before ends; nodes
    without rows repeat the last key before them. Never wrapped."""
    ends = placed.groupBy("pnode_idx").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    spark = placed.sparkSession
    nodes = spark.range(place.nodes).withColumnRenamed("id", "i")
    before = W.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    full = nodes.join(ends, F.col("i") == F.col("pnode_idx"), "left").withColumn("end", F.coalesce(F.max("b").over(before), F.lit(0)))
    start = F.coalesce(F.lag("end").over(W.orderBy("i")), F.col("a"), F.lit(0))
    return full.select(F.col("i").alias("pnode_idx"), F.col("i").alias("vnode_idx"), F.col("end").alias("node_id"), start.alias("resp_start"), F.col("end").alias("resp_end"), F.lit(False).alias("wrapped"))


def bucket_start(key: Column, tail_bits: int) -> Column:
    """First key of the storage bucket: the low ``tail_bits`` bits zero."""
    return F.shiftleft(F.shiftright(key, tail_bits), tail_bits) if tail_bits < 63 else F.lit(0).cast("long")


def node_distribution(placed: DataFrame, ring_: DataFrame, tail_bits: int = 6, by: str = "vnode_idx", exact: bool = False, key: str = "key") -> DataFrame:
    """Ring columns, ``total_count``, ``min_key``, ``max_key`` per node, nodes without rows included (their keys null).

    ``exact``: true keys, as packed nodes report; else the buckets' first keys, as uniform ones do.
    """
    k = F.col(key) if exact else bucket_start(F.col(key), tail_bits)
    held = placed.groupBy(F.col(by).alias("n_")).agg(F.count(F.lit(1)).alias("c_"), F.min(k).alias("min_key"), F.max(k).alias("max_key"))
    rows = ring_.join(held, F.col(by) == F.col("n_"), "left")
    return rows.select(*ring_.columns, F.coalesce("c_", F.lit(0)).cast("long").alias("total_count"), "min_key", "max_key")


def roll_up(distribution: DataFrame) -> DataFrame:
    """Virtual nodes summed by node; ``node_id`` is that of the node's first virtual node."""
    return distribution.groupBy("pnode_idx").agg(
        F.min_by("node_id", "vnode_idx").alias("node_id"), F.sum("total_count").alias("total_count"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")
    )


def bucket_probe(placed: DataFrame, lo: int, hi: int, tail_bits: int = 6, key: str = "key") -> DataFrame:
    """Rows of the storage buckets that meet [lo, hi]: whole buckets, so possibly more than the range holds."""
    b = bucket_start(F.col(key), tail_bits)
    return placed.filter((b <= hi) & (b + (2**tail_bits - 1) >= lo))
