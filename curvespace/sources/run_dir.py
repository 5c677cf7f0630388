"""Run directories: the tables and texts of one experiment, and reading many of them back."""

from __future__ import annotations

import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespace.params import Config

# The labels of a summary, by the name of its figure here.
SUMMARY_LABELS = {"total_hits": "Total precise hits", "hit_pnodes": "Hit pnodes", "total_hops": "Total route hops", "avg_hops": "Avg route hops"}


class RunDir:
    """``<result_dir>/run_<time>``: tables as CSV folders by Spark, small texts by the driver. A second run within a second
    gets a number. The folder has to be one that driver and executors share; on a cluster that is a mount."""

    def __init__(self, config: Config):
        base = Path(config.result_dir) / time.strftime("run_%Y%m%d_%H%M%S")
        base.parent.mkdir(parents=True, exist_ok=True)
        self.path, k = base, 1
        while True:
            try:
                self.path.mkdir()
                break
            except FileExistsError:
                k += 1
                self.path = base.with_name(f"{base.name}_{k}")
        shown = {**asdict(config.params), **asdict(config.placement), "ring_bits": config.params.ring_bits, "prefix_bits": config.prefix_bits, "stop_tail_bits": config.stop_tail_bits, "csv_path": config.input, "max_ingest": config.max_ingest, "queries": len(config.windows)}
        shown |= {f"Q{i:02}": ", ".join(f"{k}={v}" for k, v in asdict(w).items()) for i, w in enumerate(config.windows)}
        self.text("params.txt", shown)

    def table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"file://{(self.path / name).resolve()}")

    def text(self, name: str, values: dict) -> None:
        (self.path / name).parent.mkdir(parents=True, exist_ok=True)
        with (self.path / name).open("a") as f:
            f.writelines(f"{k}: {v}\n" for k, v in values.items())

    def timing(self, name: str, began: float) -> None:
        with (self.path / "timings.txt").open("a") as f:
            f.write(f"{name}_ms={round((time.perf_counter() - began) * 1000)}\n")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run, query, total_hits, hit_pnodes, total_hops, avg_hops`` of every ``root/<run>/query_<number>_<query>/summary.txt``;
    figures that are missing or no numbers are null."""
    from curvespace.sources.points import read_summary_text

    at = F.col("path")
    rows = read_summary_text(spark, f"{root}/*/query_*/summary.txt").select(
        F.regexp_extract(at, r"([^/]+)/query_\d+_[^/]*/summary\.txt$", 1).alias("run"), F.regexp_extract(at, r"query_\d+_([^/]*)/summary\.txt$", 1).alias("query"), F.col("name"), F.col("number")
    )
    figure = lambda label: F.max(F.when(F.col("name") == label, F.col("number")))
    return rows.groupBy("run", "query").agg(*[figure(label).alias(c) for c, label in SUMMARY_LABELS.items()])
