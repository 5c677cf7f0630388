"""trajectory_ids against a plain version: every row of ``events`` gets its hash."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from curvespace import queries


def fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return str(h)


def test_every_event_has_its_hash(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 0, 9, 58, 778549)
    rows = [(k, start + datetime.timedelta(seconds=977 * k), 10 + k % 3) for k in range(11)]
    cols = {"event_id": [r[0] for r in rows], "ts": [r[1] for r in rows], "user_id": [r[2] for r in rows], "event_type": ["x"] * 11, "value": [1.5] * 11, "props": ['{"k": 1}'] * 11}
    pq.write_table(pa.table(cols), tmp_path / "events.parquet")
    want = {k: fnv(str(u) if k % 4 == 0 else f"{u}_{t:%Y-%m-%dT%H:%M:%S}+00:00") for k, t, u in rows}
    got = queries.QUERIES["trajectory_ids"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.ordinal: r.traj_hash for r in got} == want
