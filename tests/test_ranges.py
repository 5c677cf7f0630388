"""Covers of mixed blocks, best ranges, the keyed store and merging of points and ranges, against plain versions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from curvespace import queries
from curvespace.operators import cover, placement, range_join, ranking, window_query
from curvespace.params import Placement, SfcParams, Window
from curvespace.sources.keyed_store import KeyedStore


def some_windows(rng, n, time):
    out = []
    for k in range(n):
        lat, lon, t = 39 + 2 * rng.random(), 115 + 3 * rng.random(), rng.randrange(time)
        out.append(Window(f"w{k}", lat, lat + rng.random(), lon, lon + 2 * rng.random(), t, t + rng.randrange(time // 3)))
    return [*out, Window("all", 39.0, 41.0, 115.0, 118.0, 0, time), Window("turned", 40.0, 39.5, 116.0, 115.5, 900, 100)]


def keys_in(spark, p, frame):
    """The keys of every window's box, cell by cell."""
    bits = range(p.bits)

    def key(x, y, z):
        if p.bucketed:
            return (z << 2 * p.bits) + sum((x >> i & 1) << 2 * i + 1 | (y >> i & 1) << 2 * i for i in bits)
        return sum((x >> i & 1) << 3 * i + 2 | (y >> i & 1) << 3 * i + 1 | (z >> i & 1) << 3 * i for i in bits)

    return {b.name: {key(x, y, z) for x in range(b.x0, b.x1 + 1) for y in range(b.y0, b.y1 + 1) for z in range(b.z0, b.z1 + 1)} for b in cover.boxes(frame, p).collect()}


def by_name(ranges):
    out = {}
    for r in ranges.collect():
        out.setdefault(r.name, []).append((r.lo, r.hi))
    return out


def length(ranges):
    return sum(hi - lo + 1 for lo, hi in ranges)


@pytest.mark.parametrize("algorithm", ["z3", "h3", "z2t", "h2t"])
def test_mixed_cover(spark, algorithm):
    p = SfcParams(algorithm, time=(0, 36_000), bits=4)
    frame = cover.windows_frame(spark, some_windows(random.Random(1), 8, 36_000))
    want = keys_in(spark, p, frame)
    exact = by_name(cover.fine_cover(frame, p))
    assert {n: {k for lo, hi in r for k in range(lo, hi + 1)} for n, r in exact.items()} == want
    for budget, most in ((30, None), (60, 4), (9, 1)):
        got = by_name(cover.fine_cover(frame, p, most, budget=budget))
        for name, ranges in got.items():
            assert len(ranges) <= (most or budget)
            assert {k for lo, hi in ranges for k in range(lo, hi + 1)} >= want[name]


def test_mixed_cover_is_never_wider_than_one_of_equal_blocks(spark):
    for k, w in enumerate(queries.WINDOWS.values()):
        frame = cover.windows_frame(spark, [w])
        own = by_name(cover.cover(frame, queries.Z3))[w.name]
        mixed = by_name(cover.fine_cover(frame, queries.Z3, most=len(own), block_bits=3 if k else 6))[w.name]
        assert len(mixed) <= len(own)
        assert length(mixed) <= length(own)


def test_best_ranges_have_the_least_length(spark):
    rng = random.Random(2)
    rows = [(f"g{g}", lo, lo + rng.randrange(12)) for g in range(12) for lo in (rng.randrange(150) for _ in range(rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, "name string, lo long, hi long")
    merged = {n: sorted(r) for n, r in by_name(cover.merge_ranges(df)).items()}
    for most in (1, 2, 3, 5, 20):
        got = by_name(cover.best_ranges(df, most))
        for name, own in merged.items():
            k = min(most, len(own)) - 1
            least = min(length([(own[a][0], own[b - 1][1]) for a, b in itertools.pairwise([0, *cuts, len(own)])]) for cuts in itertools.combinations(range(1, len(own)), k))
            assert len(got[name]) == k + 1
            assert length(got[name]) == least
    whole = by_name(cover.best_ranges(df.withColumn("name", F.lit("x")), 5))["x"]
    assert sorted(whole) == cover.union_ranges(df, 5)
    assert cover.union_ranges(df.limit(0), 5) == []


def test_a_million_ranges(spark):
    spread = F.pmod(F.xxhash64("id"), F.lit(400))
    df = spark.range(10**6).select((F.col("id") * 1000 + spread).alias("lo")).withColumn("hi", F.col("lo") + F.pmod(F.xxhash64("lo"), F.lit(500)))
    got = cover.union_ranges(df, 100)
    assert len(got) == 100
    ends = df.agg(F.min("lo"), F.max("hi")).first()
    assert (got[0][0], got[-1][1]) == tuple(ends)
    assert all(b[0] - a[1] > 700 for a, b in itertools.pairwise(got))


@pytest.mark.parametrize("how", ["last", "max", "sum"])
def test_running_values_over_parts(spark, how):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([None, rng.randrange(100)])) for k in range(500)]
    got = ranking.scanned(spark.createDataFrame(rows, "g string, k int, v int"), ["g", "k"], F.col("v"), "r", how, inclusive=how != "max").collect()
    seen, want = [], {}
    for g, k, v in sorted(rows, key=lambda r: r[:2]):
        upto = seen if how == "max" else [*seen, v]
        known = [x for x in upto if x is not None]
        want[k] = {"last": known[-1], "max": max(known), "sum": sum(known)}[how] if known else None
        seen.append(v)
    assert {r.k: r.r for r in got} == want


def test_points_in_ranges_as_in_a_plain_join(spark):
    """One window holds a third of all points and most of the ranges."""
    rng = random.Random(4)
    pts = [("hot" if rng.random() < 0.4 else f"w{rng.randrange(30)}", rng.randrange(5), rng.randrange(3000), k) for k in range(6000)] + [(None, 1, 5, -1), ("hot", None, 5, -2), ("hot", 1, None, -3)]
    ranges = [("hot" if rng.random() < 0.5 else f"w{rng.randrange(35)}", rng.randrange(5), lo, lo + rng.randrange(30)) for lo in (rng.randrange(3000) for _ in range(600))]
    df = spark.createDataFrame(pts, "name string, node int, key long, kind_of int")
    got = range_join.in_ranges(df, spark.createDataFrame(ranges, "name string, node int, lo long, hi long"), ("name", "node"))
    want = sorted(k for n, v, key, k in pts if key is not None and any((n, v) == r[:2] and r[2] <= key <= r[3] for r in ranges))
    assert sorted(r.kind_of for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert range_join.in_ranges(df, spark.createDataFrame([], "name string, node int, lo long, hi long"), ("name", "node")).isEmpty()


def test_no_part_of_a_merge_holds_a_hot_window(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("name"), F.col("id").alias("key"))
    parts = df.repartitionByRange(8, "name", "key").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 2000


def test_fetch_by_merging_equals_the_join(spark, small, monkeypatch):
    wins, place = queries.windows(spark, small), Placement("vnode", 16, 8)
    plan = window_query.fetch_plan(cover.plan_windows(wins, queries.Z3), place, queries.RING).persist()
    placed = placement.assign(queries.keyed(spark, small), queries.Z3, place)
    rows = lambda: sorted((r.name, r.ordinal) for r in window_query.fetch(placed, wins, plan, queries.Z3).collect())
    want = rows()
    monkeypatch.setattr(window_query, "MAX_ROWS", 0)
    assert want == rows()
    assert want


def test_store_opens_only_what_meets(spark, small, tmp_path):
    placed = placement.assign(queries.keyed(spark, small), queries.Z3, Placement("baseline", 64))
    store = KeyedStore(spark, f"file://{tmp_path}/s p", queries.Z3).append(placed.filter("ordinal % 2 = 0"))
    half = store.table().count()
    store.append(placed.filter("ordinal % 2 = 1"))
    assert (half, store.table().count()) == (placed.filter("ordinal % 2 = 0").count(), placed.count())
    placed.write.partitionBy("pnode_idx").parquet(f"file://{tmp_path}/s p/points/batch=failed")  # its files never came into the manifest
    every, w = store.manifest().count(), queries.WINDOWS["dense"]
    assert store.table().count() == placed.count()
    found = store.window(w)
    opened = len(found.inputFiles())
    assert 0 < opened < every
    ranges = cover.fine_cover(cover.windows_frame(spark, [w]), queries.Z3, 100, 3)
    spans = [(r.lo, r.hi) for r in ranges.collect()]
    assert opened == sum(any(lo <= m.max_key and m.min_key <= hi for lo, hi in spans) for m in store.manifest().collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: .*(Or|GreaterThanOrEqual)\(.*key", plan)
    assert len(plan) < 50_000
    assert sorted(r.ordinal for r in found.collect()) == sorted(r.ordinal for r in placed.filter(window_query.inside(w)).collect())
    none = store.window(Window("none", 40.99, 41.0, 117.99, 118.0, 0, 1))
    assert none.columns == found.columns
    assert none.isEmpty()
    node = store.node(17)
    assert {re.search(r"pnode_idx=(\d+)", f)[1] for f in node.inputFiles()} == {"17"}
    assert [r.bucket for r in node.collect()] == sorted(r.key // 64 * 64 for r in placed.filter("pnode_idx = 17").collect())


def test_an_empty_store(spark, small, tmp_path):
    placed = placement.assign(queries.keyed(spark, small), queries.Z3, Placement("baseline", 4)).limit(0)
    store = KeyedStore(spark, f"file://{tmp_path}/s", queries.Z3).append(placed)
    assert store.table().isEmpty()
    assert store.window(queries.WINDOWS["dense"]).isEmpty()


def test_windows_over_computed_keys_have_small_plans(spark, small):
    for name in queries.WINDOWS:
        assert len(queries.QUERIES[f"window_{name}"](spark, small)._jdf.queryExecution().executedPlan().toString()) < 50_000


def test_covers_of_many_windows_are_made_by_many_tasks_without_sorting_blocks(spark, small):
    for p, most in ((queries.Z3, None), (queries.Z3, 8), (queries.HILBERT, None)):
        got = cover.fine_cover(queries.windows(spark, small), p, most)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_windows_of_one_name_share_a_cover(spark):
    p = SfcParams("z3", time=(0, 36_000), bits=4)
    a, b = Window("a", 39.0, 39.5, 115.0, 116.0, 0, 9_000), Window("a", 39.3, 40.0, 115.5, 117.0, 6_000, 20_000)
    both = cover.windows_frame(spark, [a, b])
    want = set().union(*[keys_in(spark, p, cover.windows_frame(spark, [w]))["a"] for w in (a, b)])
    assert {n: {k for lo, hi in r for k in range(lo, hi + 1)} for n, r in by_name(cover.fine_cover(both, p)).items()} == {"a": want}


def test_many_windows_are_dealt_to_small_blocks(spark, small, monkeypatch):
    """More windows than the table for all tasks holds still meet few points, and a name with two windows gets a point once for each."""
    wins, pts = queries.windows(spark, small), queries.keyed(spark, small)
    wins = wins.union(wins.filter("name < 'u3'").select("name", "lat_min", (F.col("lat_max") + 0.1).alias("lat_max"), *wins.columns[3:]))
    on = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("t").between(F.col("t_start"), F.col("t_end"))
    want = sorted(map(tuple, pts.crossJoin(wins).filter(on).select("name", "ordinal").collect()))
    for most in (window_query.MAX_ROWS, 10):
        monkeypatch.setattr(window_query, "MAX_ROWS", most)
        assert window_query.grid(wins, queries.Z3) in ((2, True), (3, False))
        assert sorted(map(tuple, window_query.multi_window(pts, wins, queries.Z3).select("name", "ordinal").collect())) == want
