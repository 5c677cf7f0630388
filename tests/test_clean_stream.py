"""The cleaned stream against SQL, to the last second of the bounds and with many rows a batch."""

from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq

from curvespace.queries import ORACLE, QUERIES, RULES


def test_rows_of_the_last_second_come_out(spark, tmp_path, check_sql):
    last = datetime.fromtimestamp(RULES.time[1] - 1, timezone.utc).replace(tzinfo=None)
    rows = [(1000 * u + k + 1, last - timedelta(hours=3 * k, seconds=u if u > 2 else 0), u, 10.0 + k, k) for u in range(1, 5) for k in range(40)]
    rows += [(9000 + k, last + timedelta(microseconds=k), 1, 10.0, 0) for k in range(3)]  # equal in second and place
    rows += [(9100 + k, last + timedelta(seconds=1), 2, 90.0, 0) for k in range(2)]  # past the bound
    cols = {"event_id": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "user_id": [r[2] for r in rows], "event_type": ["x"] * len(rows), "value": [r[3] for r in rows], "props": [f'{{"k": {r[4]}}}' for r in rows]}
    pq.write_table(pa.table(cols), tmp_path / "events.parquet")
    got = QUERIES["clean_stream"](spark, str(tmp_path))
    assert got.filter("traj_id in ('1', '2')").count() > 40
    check_sql(got, ORACLE["clean_stream"], str(tmp_path))
