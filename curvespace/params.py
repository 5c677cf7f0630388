"""Curve parameters and run configuration."""

from __future__ import annotations

import json
import logging
import math
import os
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger(__name__)

ALGORITHMS = ("z3", "h3", "z2t", "h2t")


@dataclass(frozen=True)
class SfcParams:
    """What a curve key depends on: algorithm, bounds (lat, lon, seconds), bits per axis, time bucket length. ``true_hilbert``: bucketed
    keys follow the Hilbert curve in the plane."""

    algorithm: str = "z3"
    lat: tuple[float, float] = (39.0, 41.0)
    lon: tuple[float, float] = (115.0, 118.0)
    time: tuple[int, int] = (1_175_308_800, 1_346_457_600)
    bits: int = 10
    bucket_s: int = 3600
    true_hilbert: bool = False

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            object.__setattr__(self, "algorithm", "z3")  # unknown names mean z3

    @property
    def bucketed(self) -> bool:
        """Whether keys are a time bucket followed by a two-dimensional key."""
        return self.algorithm in ("z2t", "h2t")

    @property
    def num_buckets(self) -> int:
        return max(1, math.ceil((self.time[1] - self.time[0]) / self.bucket_s))

    @property
    def bucket_bits(self) -> int:
        return min(31, max(1, math.ceil(math.log2(self.num_buckets)))) if self.num_buckets > 1 else 1

    @property
    def ring_bits(self) -> int:
        """Bits of a key, which are also the width of the ring."""
        return 2 * self.bits + self.bucket_bits if self.bucketed else 3 * self.bits

    @property
    def floors(self) -> bool:
        """z3 quantizes by floor, the others by rounding half up."""
        return self.algorithm == "z3"

    @property
    def time_pad(self) -> int:
        """Seconds that a window is widened by on both sides: one time cell; bucketed keys need none."""
        return 0 if self.bucketed else math.ceil((self.time[1] - self.time[0]) / (2**self.bits - 1))


@dataclass(frozen=True)
class Window:
    """A closed space and time window."""

    name: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    t_start: int
    t_end: int


@dataclass(frozen=True)
class Placement:
    """How keys are dealt to nodes: ``baseline``, ``vnode`` or ``snode`` (case does not matter; others raise)."""

    mode: str = "baseline"
    nodes: int = 128
    vnodes: int = 1
    low_ratio: float = 0.95
    high_ratio: float = 1.10

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.lower())
        if self.mode not in ("baseline", "vnode", "snode"):
            raise ValueError(f"unknown placement mode: {self.mode}")


@dataclass(frozen=True)
class Config:
    params: SfcParams = field(default_factory=SfcParams)
    placement: Placement = field(default_factory=Placement)
    windows: tuple[Window, ...] = ()
    input: str = ""
    result_dir: str = "results"
    max_ingest: int | None = None
    prefix_bits: int | None = None
    stop_tail_bits: int = 6


# Names of the configuration file's keys. Those that only print or that bound a search by visits have no
# effect here and are accepted silently.
_BLOCKS = {
    "dataset": {"lat_range", "lon_range", "time_range"},
    "sfc": {"algorithm", "center_lat", "time_bucket_s", "max_depth", "max_nodes", "max_ranges", "tail_bits_guard", "bits", "bucket_s", "lat", "lon", "time"},
    "data": {"csv_path", "max_ingest"},
    "output": {"result_dir"},
    "network": {"num_nodes"},
    "placement": {"mode", "vnodes_per_node", "vnode_bits", "online_counting", "guard_last_bucket", "smart", "nodes", "vnodes"},
    "experiment": {"stop_tail_bits", "print_first", "debug", "prefix_bits", "metrics", "queries", "max_ingest"},
    "smart": {"low_ratio", "high_ratio"},
    "input": {"path"},
    "windows": set(),
}


def config_path(args: list[str]) -> str:
    """Where the configuration lies: the first argument, else the environment's ``CONFIG``, else ``config.yaml``."""
    return args[0] if args else os.environ.get("CONFIG") or "config.yaml"


def load_config(source: str | Path | dict) -> Config:
    """A :class:`Config` from a dict, or a JSON or YAML file. Unknown keys are accepted with a warning."""
    from curvespace.functions.timeparse import seconds_of

    if not isinstance(source, dict):
        text = Path(source).read_text()
        if str(source).endswith(".json"):
            source = json.loads(text)
        else:
            import yaml

            source = yaml.safe_load(text)
    for k, own in source.items():
        if k not in _BLOCKS:
            log.warning("configuration key without effect: %s", k)
        elif isinstance(own, dict):
            for inner in set(own) - _BLOCKS[k]:
                log.warning("configuration key without effect: %s.%s", k, inner)

    def get(*paths: str, default=None):
        """The first value given under one of ``paths`` (block.key); nulls count as not given."""
        for path in paths:
            at = source
            for part in path.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            if at is not None:
                return at
        return default

    base = SfcParams()
    params = SfcParams(
        get("sfc.algorithm", default=base.algorithm), tuple(map(float, get("dataset.lat_range", "sfc.lat", default=base.lat))), tuple(map(float, get("dataset.lon_range", "sfc.lon", default=base.lon))),
        tuple(map(int, get("dataset.time_range", "sfc.time", default=base.time))), get("sfc.bits", default=base.bits), max(1, get("sfc.time_bucket_s", "sfc.bucket_s", default=base.bucket_s)),
    )
    place = Placement(
        get("placement.mode", default="baseline"), get("network.num_nodes", "placement.nodes", default=128), get("placement.vnodes_per_node", "placement.vnodes", default=8),
        get("placement.smart.low_ratio", "smart.low_ratio", default=0.95), get("placement.smart.high_ratio", "smart.high_ratio", default=1.10),
    )

    def bound(text: object, default: int) -> int:
        got = seconds_of(str(text)) if text is not None else None
        return default if got is None else got

    windows = tuple(
        Window(w.get("name") or f"window_{i:02}", float(w["lat_min"]), float(w["lat_max"]), float(w["lon_min"]), float(w["lon_max"]), bound(w.get("t_start"), params.time[0]), bound(w.get("t_end"), params.time[1]))
        for i, w in enumerate(get("experiment.queries", "windows", default=[]))
    )
    cap = get("data.max_ingest", "experiment.max_ingest")
    return Config(params, place, windows, get("data.csv_path", "input.path", default=""), get("output.result_dir", default="results"), cap or None, get("experiment.prefix_bits"), get("experiment.stop_tail_bits", default=6))
