"""Load and cost analytics over placements and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespace.params import SfcParams


def load_vector(distribution: DataFrame, nodes: int) -> DataFrame:
    """``pnode_idx, total_count`` of every node 0 to ``nodes`` - 1; missing ones hold 0."""
    sums = distribution.groupBy(F.col("pnode_idx").cast("long").alias("p_")).agg(F.sum("total_count").alias("n_"))
    all_ = distribution.sparkSession.range(nodes).withColumnRenamed("id", "pnode_idx")
    return all_.join(sums, F.col("pnode_idx") == F.col("p_"), "left").select("pnode_idx", F.coalesce("n_", F.lit(0)).cast("long").alias("total_count"))


def load_rank(load: DataFrame) -> DataFrame:
    """With ``rank_axis``: the node's place by number, from 0."""
    return load.withColumn("rank_axis", (F.row_number().over(W.orderBy("pnode_idx")) - 1).cast("long"))


def downsample(ranked: DataFrame, most: int = 12_000) -> DataFrame:
    """Every ceil(n / most)-th row by ``rank_axis``, from the first."""
    n = ranked.count()
    return ranked.filter(F.col("rank_axis") % max(1, -(-n // most)) == 0)


def load_ecdf(load: DataFrame) -> DataFrame:
    """``total_count, ecdf``: the sorted loads and place / n; equal loads keep different places."""
    place = F.row_number().over(W.orderBy("total_count", "pnode_idx"))
    return load.select("pnode_idx", "total_count", (place / F.count(F.lit(1)).over(W.partitionBy())).alias("ecdf"))


def zero_share(load: DataFrame) -> DataFrame:
    """``zero_pct, min_positive``."""
    return load.agg((F.avg((F.col("total_count") <= 0).cast("double")) * 100).alias("zero_pct"), F.min(F.when(F.col("total_count") > 0, F.col("total_count"))).alias("min_positive"))


def balance(load: DataFrame) -> DataFrame:
    """``max_over_mean, variation``: two measures of imbalance (an addition)."""
    mean = F.avg("total_count")
    return load.agg((F.max("total_count") / mean).alias("max_over_mean"), (F.stddev_pop("total_count") / mean).alias("variation"))


def human(v):
    """A number with K, M, B, T or P."""
    v = F.col(v) if isinstance(v, str) else v
    out = F.format_string("%.0f", v.cast("double"))
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T"), (1e15, "P")):
        out = F.when(F.abs(v) >= size, F.concat(F.format_string("%.1f", v / size), F.lit(unit))).otherwise(out)
    return out


def scheme_key(name):
    """``rank, p, v`` of a run's name: op before snode before p..v.."""
    name = F.col(name) if isinstance(name, str) else name
    num = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    rank = F.when(name.startswith("op"), 0).when(name.startswith("snode"), 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.coalesce(num(r"^(?:op|snode|p)(\d+)"), F.lit(0)).alias("p"), F.coalesce(num(r"v(\d+)$"), F.lit(0)).alias("v"))


def scheme_matrix(metrics: DataFrame, runs: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """``query`` by run: every run and query has a cell, null where the metric is missing. ``runs(run)`` and
    ``queries(query)`` name rows and columns; both are few."""
    names = [r.run for r in runs.orderBy(scheme_key("run")).collect()]
    grid = queries.crossJoin(runs).join(metrics, ["run", "query"], "left")
    return grid.groupBy("query").pivot("run", names).agg(F.first(metric))


def density_pyramid(points: DataFrame, p: SfcParams, levels: tuple[int, ...], key: str = "key") -> DataFrame:
    """``level, cell, n``: points in every cell of each level that holds any; a level is the bits of an axis that its cells keep.
    Keys begin with their coarser cells, so one pass of grouping sets over prefixes counts all levels; rows without a key are in
    none. Of bucketed keys the plane's part counts, over all buckets."""
    step = 2 if p.bucketed else 3
    k = F.col(key) % 2 ** (2 * p.bits) if p.bucketed else F.col(key)
    at = sorted(set(levels))
    names = [f"l{n}" for n in at]
    cells = points.filter(F.col(key).isNotNull()).select(*[F.shiftright(k, step * (p.bits - n)).alias(c) for n, c in zip(at, names, strict=True)])
    sums = cells.rollup(*names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g_"))
    # grouping_id has a bit for each prefix that is rolled up, the finest last
    level, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (n, c) in enumerate(zip(at, names, strict=True)):
        own = F.col("g_") == 2 ** (len(at) - 1 - i) - 1
        level, cell = F.when(own, n).otherwise(level), F.when(own, F.col(c)).otherwise(cell)
    return sums.select(level.alias("level"), cell.alias("cell"), "n").filter("level IS NOT NULL")


def key_histogram(points: DataFrame, key: str = "key") -> DataFrame:
    """``run_length, n_keys``: how many keys occur how often."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("run_length")).groupBy("run_length").agg(F.count(F.lit(1)).alias("n_keys"))


def ingest_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon", "t") for n, f in (("min", F.min), ("max", F.max))])


def output_bounds(kept: DataFrame) -> DataFrame:
    """Least and greatest latitude, longitude and time of cleaned points."""
    return kept.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon", "ts") for n, f in (("min", F.min), ("max", F.max))])


def observed_nodes(distribution: DataFrame) -> DataFrame:
    """``n_nodes``: how many different nodes a distribution names."""
    return distribution.agg(F.countDistinct("pnode_idx").alias("n_nodes"))


def point_sample(points: DataFrame, n: int, ident: str = "ordinal") -> DataFrame:
    """``n`` points chosen by the hash of their id: the same ones in every run. The limit is the feature."""
    return points.orderBy(F.md5(F.col(ident).cast("string")), ident).limit(n)


# The grid of runs of an evaluation; the largest number of virtual nodes has no run at the largest ring.
GRID_NODES, GRID_VNODES, GRID_WITHOUT = (128, 1024, 8192), (10, 100, 1000, 10000), {(8192, 10000)}
#: Where zeros are shown on a logarithmic axis: this share of the least positive load.
ZERO_FLOOR = 0.08


def grid_runs() -> list[str]:
    """Names of all runs of the grid, in the order of :func:`scheme_key` within each size of ring."""
    return [n for p in GRID_NODES for n in (f"op{p}", f"snode{p}", *[f"p{p}v{v}" for v in GRID_VNODES if (p, v) not in GRID_WITHOUT])]


def run_matrix(runs: DataFrame, metric: str, expected: list[str] | None = None, queries: list[str] | None = None) -> DataFrame:
    """``query`` by run, of :func:`curvespace.sources.run_dir.read_runs`: a cell for every run and query, null where one
    is missing. ``expected`` and ``queries`` name runs and queries that have a column or row whether or not anything is known of
    them (see :func:`grid_runs`); others are left out. Without them: those that are there."""
    if expected is None:
        expected = [r.run for r in runs.select("run").distinct().orderBy(scheme_key("run")).collect()]
    sums = runs.groupBy("query").pivot("run", expected).agg(F.first(metric))
    if queries is None:
        return sums
    names = runs.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    return names.join(sums, "query", "left")


def metric_scale(runs: DataFrame, metric: str = "hit_pnodes", against: str = "total_hops") -> DataFrame:
    """``max_metric, max_against, ratio``: the greatest value of two metrics over all runs and queries, and the factor that brings the
    second to the first one's scale; 1 where either is missing or the second is 0."""
    most = runs.agg(F.max(metric).cast("double").alias("max_metric"), F.max(against).cast("double").alias("max_against"))
    return most.withColumn("ratio", F.coalesce(F.when(F.col("max_against") != 0, F.col("max_metric") / F.col("max_against")), F.lit(1.0)))


def shown_loads(loads: DataFrame) -> DataFrame:
    """``loads(run, pnode_idx, total_count)`` with ``shown``, the value on a logarithmic axis: zeros lie at one floor for all runs, a share of
    the least positive load (1, if there is none)."""
    least = loads.agg(F.coalesce(F.min(F.when(F.col("total_count") > 0, F.col("total_count"))), F.lit(1)).alias("least_"))
    floor = F.greatest(F.col("least_") * F.lit(ZERO_FLOOR), F.lit(1e-12))
    return loads.crossJoin(F.broadcast(least)).withColumn("shown", F.when(F.col("total_count") > 0, F.col("total_count").cast("double")).otherwise(floor)).drop("least_")  # one row


def observed_groups(loads: DataFrame) -> DataFrame:
    """``n_nodes, run, pnode_idx, total_count, rank_axis``: the nodes that each run names (none is filled in), with the run's number of
    different nodes, by which runs are grouped, and the node's place by number among them, from 0."""
    many = loads.groupBy(F.col("run").alias("run_")).agg(F.countDistinct("pnode_idx").alias("n_nodes"))
    rank = (F.row_number().over(W.partitionBy("run").orderBy("pnode_idx")) - 1).cast("long")
    return loads.withColumn("rank_axis", rank).join(many, F.col("run") == F.col("run_")).select("n_nodes", "run", "pnode_idx", "total_count", "rank_axis")


def sampled_keys(points: DataFrame, every: int = 50_000, key: str = "key", ordinal: str = "ordinal") -> DataFrame:
    """The keys of every ``every``-th row in order of arrival."""
    return points.filter(F.col(ordinal) % every == 0).select(ordinal, key)
