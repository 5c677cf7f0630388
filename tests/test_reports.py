"""Reports of many windows: counted without their points, equal to the report on the points themselves."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curvespace.functions import curves
from curvespace.operators import cover, placement, window_query
from curvespace.params import Placement, SfcParams

P = SfcParams("z3", time=(0, 1023 * 1000))


def tables(spark, copies, n=40):
    """Windows and points, each ``copies`` times; a window without a name, one of two boxes, points with nulls."""
    rng = random.Random(3)
    spots = [(39 + 2 * rng.random(), 115 + 3 * rng.random(), rng.randrange(1023 * 1000)) for _ in range(300)]
    boxes = [(la - 0.2, la + 0.2, lo - 0.3, lo + 0.3, t - 90_000, t + 90_000) for la, lo, t in spots[:n]]
    windows = [(f"w{k}_{c}", *b) for k, b in enumerate(boxes) for c in range(copies)]
    windows += [(None, *boxes[0]), ("both", *boxes[1]), ("both", *boxes[2])]
    points = [s for s in spots for _ in range(copies)] + [(None, 116.0, 5), (39.5, None, 5), (39.5, 116.0, None)]
    pts = spark.createDataFrame(points, "lat double, lon double, t long").withColumn("key", curves.encode(P, F.col("lat"), F.col("lon"), F.col("t")))
    return pts, spark.createDataFrame(windows, cover.WINDOW_SCHEMA)


@pytest.mark.parametrize("most", [100_000, 5])
@pytest.mark.parametrize("place", [Placement("baseline", 64), Placement("vnode", 16, 8)])
def test_a_counted_report_is_that_of_the_points(spark, monkeypatch, place, most):
    monkeypatch.setattr(window_query, "MAX_ROWS", most)
    pts, wins = tables(spark, 3, 12)
    placed = placement.assign(pts, P, place)
    plan = window_query.fetch_plan(cover.plan_windows(wins, P), place, P.ring_bits)
    want = window_query.pnode_report(plan, window_query.fetch(placed, wins, plan, P), place, P.ring_bits)
    got = window_query.window_report(placed, wins, P, place)
    assert got.columns == want.columns
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(tuple(r) for r in want.collect())
    assert sum(r[2] for r in rows) > 100


def test_copies_of_windows_and_points_meet_once(spark, monkeypatch):
    """Ten times the windows and points are a hundred times the hits, but no more rows to be held against the plan."""
    place, seen = Placement("baseline", 64), []
    planned = window_query._planned
    monkeypatch.setattr(window_query, "_planned", lambda found, plan, key="key": (seen.append((found.count(), plan.count())), planned(found, plan, key))[1])
    hits = []
    for copies in (1, 10):
        pts, wins = tables(spark, copies)
        hits.append(window_query.window_report(placement.assign(pts, P, place), wins.filter("name LIKE 'w%'"), P, place).agg(F.sum("returned_count")).first()[0])
    assert hits[1] == 100 * hits[0]
    assert seen[0] == seen[1]
