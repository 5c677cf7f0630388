"""A whole experiment: ingest, encode, place, export, then every window with its report."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespace.functions.curves import encode
from curvespace.functions.timeparse import rfc3339
from curvespace.operators.clean import with_ordinal
from curvespace.operators.cover import cover, plan_stats, plan_windows, windows_frame
from curvespace.operators.placement import assign, node_distribution, ring, roll_up, snode_ring
from curvespace.operators.window_query import distinct_hits, fetch, fetch_plan, fetch_plan_on, pnode_report, query_summary
from curvespace.params import Config
from curvespace.plans.analytics import ingest_bounds
from curvespace.sources.keyed_store import KeyedStore
from curvespace.sources.points import read_clean_csv
from curvespace.sources.run_dir import SUMMARY_LABELS, RunDir
from curvespace.sources.shared import keep, shared_dir

# Fixed values below: the names of folders, files, columns and labels, which other programs read.


def placed_points(points: DataFrame, config: Config) -> DataFrame:
    """``points`` (of :func:`read_clean_csv`) with ``segment_id``, ``key``, ``pnode_idx`` and ``vnode_idx``."""
    p = config.params
    keyed = with_ordinal(points, "t", "place").withColumn("key", encode(p, F.col("lat"), F.col("lon"), F.col("t")))
    return assign(keyed, p, config.placement, [F.col("traj_id"), F.col("t"), F.col("segment_id")])


def export(out: RunDir, placed: DataFrame, nodes: DataFrame, mode: str) -> None:
    """Loads, ranges and contents of the nodes: by virtual node where there are some, else by node."""
    held = keep(node_distribution(placed, nodes, exact=mode == "snode"))
    stored = [F.col("total_count").alias("stored_total"), F.col("min_key").alias("stored_min"), F.col("max_key").alias("stored_max")]
    at = ["pnode_idx", "vnode_idx", "vnode_id"] if mode == "vnode" else ["pnode_idx", "node_id"]
    own = held.withColumn("vnode_id", F.col("node_id"))
    out.table("node_distribution.csv", own.select(*at, "total_count", "min_key", "max_key").orderBy(*at))
    out.table("node_ranges.csv", own.select(*at, "resp_start", "resp_end", "wrapped", *stored).orderBy(*at))
    if mode == "vnode":
        out.table("pnode_distribution.csv", roll_up(held).orderBy("pnode_idx"))
    ids = own.select(F.col("vnode_idx").alias("v_"), "node_id", "vnode_id")
    dump = placed.join(F.broadcast(ids), F.col("vnode_idx") == F.col("v_"))  # a row for each node of the configuration
    out.table("node_dump.csv", dump.select(*at, "key", "user", "traj_id", "lat", "lon", "datetime"))


def run(spark: SparkSession, config: Config) -> RunDir:
    """Every artefact of one run, in its directory. Points are placed once, into a keyed store, of which a window reads the files of its
    planned nodes that meet its ranges. A window's answer is what the nodes of its fetch plan return. Packed rings are not
    uniform: their hops stay null."""
    out = RunDir(config)
    p, place = config.params, config.placement
    began = time.perf_counter()
    store = KeyedStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", p)
    placed = store.append(placed_points(read_clean_csv(spark, config.input, config.max_ingest), config)).table()
    out.timing("ingest", began)
    nodes = keep(snode_ring(placed, place) if place.mode == "snode" else ring(spark, place, p.ring_bits))
    export(out, placed, nodes, place.mode)
    out.text("ingest_summary.txt", ingest_bounds(placed).first().asDict())
    for i, w in enumerate(config.windows):
        began = time.perf_counter()
        folder, frame = f"query_{i:02}_{w.name}", windows_frame(spark, [w])
        block = 4 if p.bucketed else 6
        ranges = keep(plan_windows(frame, p, block, config.prefix_bits, config.stop_tail_bits))
        plan = keep(fetch_plan_on(ranges, nodes, p.ring_bits) if place.mode == "snode" else fetch_plan(ranges, place, p.ring_bits))
        hits = keep(fetch(store.read(plan), frame, plan, p))
        raw = plan_stats(cover(frame, p, block)).first().n_ranges
        out.text(f"{folder}/window.txt", {**w.__dict__, "n_raw_ranges": raw, **plan_stats(ranges).first().asDict()})
        out.table(f"{folder}/query_results.csv", hits.select("user", "traj_id", "lat", "lon", rfc3339(F.col("t")).alias("datetime")))
        report = keep(pnode_report(plan, hits, place, p.ring_bits))
        out.table(f"{folder}/pnode_report.csv", report.select("pnode_idx", "returned_count", "route_hops").orderBy("pnode_idx"))
        found, unique = query_summary(report).first(), distinct_hits(hits, ("traj_hash", "segment_id", "key")).first()
        figures = {label: found[c] if found else 0 for c, label in SUMMARY_LABELS.items()}
        out.text(f"{folder}/summary.txt", {"Query": f"#{i} {w.name}", **figures, "Distinct hits": unique.distinct_hits if unique else 0})
        out.timing(f"query[{w.name}]", began)
    return out
