"""Cleaning of raw points as they arrive: the rules of :mod:`curvespace.operators.clean` with keyed state and timers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curvespace.functions.geo import EARTH_M
from curvespace.functions.timeparse import local_to_utc
from curvespace.operators.clean import CleanRules, row_reason
from curvespace.sources.shared import ready

#: State holds rows as the bytes of such arrays, a value for each trajectory and batch.
_POINT = np.dtype([("ordinal", "<i8"), ("lat", "<f8"), ("lon", "<f8"), ("dt_s", "<i8")])
_STAYS = np.dtype([*_POINT.descr, ("dist_m", "<f8")])
_OUT = "traj_id string, ordinal long, lat double, lon double, ts timestamp, dist_m double, segment_id int"


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    s, t = math.sin((p2 - p1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = s * s + math.cos(p1) * math.cos(p2) * t * t
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


class Cleaner(StatefulProcessor):
    """One trajectory. Points wait until the watermark has passed their second, then go on in order; state holds those that wait, the
    last point that was not a repeat, how many stay, and, until these are enough, the points that stay."""

    def __init__(self, rules: CleanRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "points binary")
        self.last = handle.getValueState("last", "lat double, lon double, dt_s long")
        self.stay = handle.getValueState("stay", "n int")
        self.held = handle.getListState("held", "points binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = None
        for pdf in rows:
            points = np.empty(len(pdf), _POINT)
            for c in _POINT.names:
                points[c] = pdf[c].astype(_POINT[c])
            self.waiting.appendValue((points.tobytes(),))
            least = min([int(pdf.dt_s.min()), *([least] if least is not None else [])])
        if least is not None:
            self.handle.registerTimer(max(least * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        parts = [np.frombuffer(r[0], _POINT) for r in self.waiting.get()]
        if not parts:  # an earlier timer took them
            return
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["ordinal"], rows["dt_s"]))]
        k = int(np.searchsorted(rows["dt_s"] * 1000, now))
        ready, rest = rows[:k].tolist(), rows[k:]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest["dt_s"][0]) * 1000 + 1)
        last = tuple(self.last.get()) if self.last.exists() else None
        n = self.stay.get()[0] if self.stay.exists() else 0
        seen, out, r = set(), [], self.rules
        for ordinal, lat, lon, second in ready:
            if (second, lat, lon) in seen:
                continue
            seen.add((second, lat, lon))
            far = math.nan
            bad = False
            if last is not None:
                far, gap = metres(last[0], last[1], lat, lon), second - last[2]
                bad = far / max(1.0, gap) * 3.6 > r.max_kmh or (far < r.min_metres and gap < max(r.min_seconds, 1))
            last = (lat, lon, second)
            if not bad:
                out.append((ordinal, lat, lon, second, far))
        if last is not None:
            self.last.update(last)
        if not out:
            return
        held = [x for r in self.held.get() for x in np.frombuffer(r[0], _STAYS).tolist()] if self.held.exists() else []
        first, out = n - len(held), [*held, *out]
        n = first + len(out)
        self.stay.update((n,))
        if n < r.min_points:
            self.held.put([(np.array(out, _STAYS).tobytes(),)])
            return
        self.held.clear()
        yield pd.DataFrame({
            "traj_id": key[0], "ordinal": [x[0] for x in out], "lat": [x[1] for x in out], "lon": [x[2] for x in out],
            "ts": pd.to_datetime([x[3] for x in out], unit="s"), "dist_m": [x[4] for x in out], "segment_id": range(first, n),
        })

    def close(self) -> None:
        pass


def clean_stream(raw: DataFrame, rules: CleanRules = CleanRules(), late: str = "10 minutes") -> DataFrame:
    """The rows of a stream ``raw(traj_id, ordinal, lat, lon, date, time)`` that stay, as :func:`curvespace.operators.clean.tag` tells them,
    with ``ts``, ``dist_m`` from the row before and ``segment_id``, their place in the trajectory. A row comes out when the
    watermark, ``late`` behind the latest one, has passed its second and its trajectory has ``min_points`` rows that stay; rows that come
    after the watermark are dropped. Needs the RocksDB state store and the append mode."""
    ready(raw.sparkSession)
    rows = raw.withColumn("ts", local_to_utc(F.col("date"), F.col("time"), rules.zone)).withColumn("dt_s", F.unix_seconds("ts"))
    good = rows.filter(row_reason(rules).isNull() & F.col("traj_id").isNotNull()).withWatermark("ts", late)
    cleaned = good.groupBy("traj_id").transformWithStateInPandas(Cleaner(rules), _OUT, "Append", "EventTime")
    return cleaned.withColumn("dist_m", F.nanvl("dist_m", F.lit(None).cast("double")))
