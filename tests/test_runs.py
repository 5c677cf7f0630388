"""Packing, the shipped configuration, window plans, whole runs and whole cleanings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespace.operators import clean, cover, placement, routing, window_query
from curvespace.params import Config, Placement, SfcParams, Window, config_path, load_config
from curvespace.plans import analytics, cleaning, experiment
from curvespace.sources import keyed_store, points, run_dir

# The configuration as it ships.
CONFIG = """
dataset: {lat_range: [39.0, 41.0], lon_range: [115.0, 118.0], time_range: [1176268800, 1343433600]}
sfc: {algorithm: "z3", center_lat: 39.9, max_depth: 24, max_nodes: 50000, tail_bits_guard: null, max_ranges: null}
data: {csv_path: "clean.csv", max_ingest: null}
output: {result_dir: "results"}
network: {num_nodes: 8192}
placement: {mode: "snode", vnodes_per_node: 10, online_counting: true, guard_last_bucket: true, smart: {low_ratio: 0.99, high_ratio: 1.05}}
experiment:
  stop_tail_bits: 6
  print_first: 15
  debug: false
  prefix_bits: null
  metrics: {compute_node_cover: true, save_with_nodes: true, precise_hits: true}
  queries:
    - {name: forbidden_city, lat_min: 39.906, lon_min: 116.386, lat_max: 39.923, lon_max: 116.411, t_start: "2008-08-01T03:00:00Z", t_end: "2008-08-10T03:15:00Z"}
    - {name: Guomao_CBD, lat_min: 39.906, lon_min: 116.440, lat_max: 39.923, lon_max: 116.480, t_start: "2008-08-01T03:00:00Z", t_end: "2008-08-10T03:15:00Z"}
    - {name: Changping_District, lat_min: 40.080, lon_min: 116.220, lat_max: 40.150, lon_max: 116.300, t_start: "2008-08-01T03:00:00Z", t_end: "2008-08-10T03:15:00Z"}
"""


def packed(runs, nodes, low, high):
    """Rows of each node, dealt out one run after another."""
    mean = sum(runs) / nodes
    low, high = max(1, math.floor(mean * low)), math.ceil(mean * high)
    held, node = [0] * (nodes + 1), 0
    for run in runs:
        while run and node < nodes:
            enough = held[node] >= low
            room = high - held[node]
            take = min(run, max(1, room) if enough else room)
            held[node] += take
            run -= take
            if enough or run:
                node += 1
        held[nodes] += run
    held[nodes - 1] += held.pop()
    return held


def test_packing_of_runs():
    rng = random.Random(3)
    for _ in range(400):
        runs = [rng.choice([1, 1, 2, rng.randrange(1, 70)]) for _ in range(rng.randrange(1, 90))]
        nodes, ratios = rng.randrange(1, 12), rng.choice([(0.95, 1.1), (0.99, 1.05), (0.5, 2.0), (1.0, 1.0)])
        state = placement.Packing.of(nodes, sum(runs), *ratios)
        ends, cut = np.cumsum(runs), rng.randrange(len(runs) + 1)
        for part in (ends[:cut], ends[cut:]):
            state.take(part)
        firsts = [0, *state.ends[: nodes - 1]]
        firsts += [sum(runs)] * (nodes - len(firsts))
        assert [b - a for a, b in zip(firsts, [*firsts[1:], sum(runs)], strict=True)] == packed(runs, nodes, *ratios)


@pytest.mark.parametrize("most", [7, 1 << 22])
def test_packed_placement_of_long_runs(spark, monkeypatch, most):
    monkeypatch.setattr(placement, "RUNS", most)  # few keys a range: the state goes through many
    rng = random.Random(5)
    runs = [rng.choice([1, 2, 3, 40]) for _ in range(60)]
    rows = [(k, k * 1000 + j) for k, n in enumerate(runs) for j in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, ordinal long")
    got = placement.assign(df, SfcParams(), Placement("snode", 16, low_ratio=0.9, high_ratio=1.2), [F.col("ordinal")]).collect()
    want = [k for k, n in enumerate(packed(runs, 16, 0.9, 1.2)) for _ in range(n)]
    assert [r.pnode_idx for r in sorted(got, key=lambda r: (r.key, r.ordinal))] == want
    assert placement.assign(df.limit(0), SfcParams(), Placement("snode", 4)).count() == 0


def test_ends_of_nodes_are_found_in_few_reads(spark, monkeypatch):
    """One job more or less whatever the keys, and two row groups a node."""
    monkeypatch.setattr(placement, "RUNS", 128)
    place, jobs = Placement("snode", 10, low_ratio=0.99, high_ratio=1.05), []
    for n in (500, 50_000):
        df = spark.range(n).withColumn("key", F.col("id") * 7 % n)
        spark.sparkContext.setJobGroup(f"ends{n}", "")
        got = placement.packed_ends(df, place)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ends{n}")))
        state = placement.Packing.of(10, n, 0.99, 1.05)
        state.take(np.arange(1, n + 1))
        assert got == state.ends
    assert jobs[0] == jobs[1] < 10, jobs

    files = sorted((r.part, r.file, r.last) for r in placement.run_ends(df).groupBy("part", F.col("_metadata.file_path").alias("file")).agg(F.max("end").alias("last")).collect())
    runs, state = placement.RunEnds([f[1:] for f in files]), placement.Packing.of(10, n, 0.99, 1.05)
    assert runs.total == n
    while len(state.ends) < 10 and (group := runs.group(state.wanted)) is not None:
        assert len(group) <= 128
        state.take(group)
    assert state.ends == got
    assert runs.reads <= 20


def test_shipped_configuration(spark, tmp_path, caplog):
    (tmp_path / "config.yaml").write_text(CONFIG)
    c = load_config(tmp_path / "config.yaml")
    assert not caplog.records
    assert (c.params.algorithm, c.params.lat, c.params.lon, c.params.time) == ("z3", (39.0, 41.0), (115.0, 118.0), (1176268800, 1343433600))
    assert c.placement == Placement("snode", 8192, 10, 0.99, 1.05)
    assert (c.input, c.result_dir, c.max_ingest, c.prefix_bits, c.stop_tail_bits) == ("clean.csv", "results", None, None, 6)
    assert [(w.name, w.t_start, w.t_end) for w in c.windows] == [(n, 1217559600, 1218338100) for n in ("forbidden_city", "Guomao_CBD", "Changping_District")]
    load_config({"sfc": {"colour": 1}, "other": {}})
    assert [r.args for r in caplog.records] == [("sfc", "colour"), ("other",)]


def test_shipped_windows_have_their_ranges_and_hops(spark, tmp_path):
    (tmp_path / "config.yaml").write_text(CONFIG)
    c = load_config(tmp_path / "config.yaml")
    ranges = cover.plan_windows(cover.windows_frame(spark, c.windows), c.params).persist()
    stats = {r.name: (r.n_ranges, r.n_keys) for r in cover.plan_stats(ranges).collect()}
    assert stats == {"forbidden_city": (19, 2304), "Guomao_CBD": (30, 3840), "Changping_District": (95, 13440)}
    hops = {}
    for n in (128, 1024, 8192):
        place = Placement("baseline", n)
        plan = window_query.fetch_plan(ranges, place, 30)
        none = spark.createDataFrame([], "name string, pnode_idx long")
        for r in window_query.query_summary(window_query.pnode_report(plan, none, place, 30)).collect():
            hops[r.name, n] = (r.hit_pnodes, r.total_hops)
    for name in ("forbidden_city", "Guomao_CBD"):
        assert [hops[name, n] for n in (128, 1024, 8192)] == [(2, 9), (2, 14), (2, 17)]
    assert [hops["Changping_District", n] for n in (128, 1024, 8192)] == [(2, 7), (4, 22), (4, 26)]


def test_wide_covers_stay_bounded_and_whole(spark):
    time = (0, 1023 * 1000)
    for a in ("z3", "h3", "z2t", "h2t"):
        p = SfcParams(a, time=time)
        w = [Window("all", *p.lat, *p.lon, *time), Window("small", 39.5, 39.51, 116.0, 116.01, 5000, 9000)]
        fine = cover.cover(cover.windows_frame(spark, w), p, 4 if p.bucketed else 6)
        coarse = cover.cover(cover.windows_frame(spark, w), p, 4 if p.bucketed else 6, most=50)
        if p.bucketed:  # 285 buckets of the whole plane: one range
            assert [(r.lo, r.hi) for r in fine.filter("name = 'all'").collect()] == [(0, (p.num_buckets << 20) - 1)]
        lost = fine.alias("f").join(coarse.alias("c"), F.expr("f.name = c.name AND c.lo <= f.lo AND f.hi <= c.hi"), "left_anti")
        assert lost.filter("name = 'small'").count() == 0
        assert coarse.count() <= 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_windows_are_joined_by_block(spark, small):
    from curvespace import queries

    rng = random.Random(1)
    wins = []
    for k in range(150):
        lat, lon, t = 39 + rng.random(), 115 + 2 * rng.random(), queries.TIME[0] + rng.randrange(2_000_000)
        wins.append(Window(f"w{k}", lat, lat + rng.random(), lon, lon + rng.random(), t, t + 600_000))
    frame, pts = cover.windows_frame(spark, wins), queries.keyed(spark, small).persist()
    for a in ("z3", "h2t"):
        found = window_query.multi_window(pts, frame, queries.PARAMS[a])
        assert "NestedLoop" not in plan_of(found)
        got = sorted((r.name, r.ordinal) for r in found.collect())
        assert got == sorted((w.name, r.ordinal) for w in wins for r in pts.filter(window_query.inside(w)).select("ordinal").collect())
    ranges = cover.union_ranges(cover.cover(frame, queries.Z3), window_query.MAX_RANGES)
    assert len(ranges) <= window_query.MAX_RANGES
    held = {r.ordinal for r in pts.filter(keyed_store.between_any("key", ranges)).collect()}
    assert held >= {o for _, o in got}


def test_ranges_meet_as_in_a_plain_join(spark):
    rng = random.Random(2)
    pair = lambda: sorted(rng.randrange(2000) for _ in range(2))
    a, b = ([(k, *pair()) for k in range(60)] for _ in range(2))
    got = cover.meeting(spark.createDataFrame(a, "a long, lo long, hi long"), spark.createDataFrame(b, "b long, b_lo long, b_hi long"), 6)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x, y) for x, lo, hi in a for y, c, d in b if lo <= d and c <= hi)


@pytest.mark.parametrize("mode", ["baseline", "vnode", "snode"])
def test_reports_of_a_run(spark, tmp_path, mode):
    lines = ["uid,TID,Latitude,lng,time", *[f"u{k % 3},t{k % 5},{39 + k / 500},{115 + k / 200},{1_200_000_000 + 60 * k}" for k in range(500)], "u,t,bad,116,0", "short"]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    w = (Window("w", 39.2, 39.6, 115.0, 117.0, 1_200_000_000, 1_200_030_000), Window("none", 40.9, 41.0, 115.0, 115.1, 0, 1))
    config = Config(SfcParams(), Placement(mode, 8, 4), w, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    first, second = experiment.run(spark, config), experiment.run(spark, config)
    assert first.path != second.path
    head = lambda f: next(first.path.glob(f"{f}/part-*")).read_text().splitlines()[0]
    at = "pnode_idx,vnode_idx,vnode_id" if mode == "vnode" else "pnode_idx,node_id"
    assert head("node_distribution.csv") == f"{at},total_count,min_key,max_key"
    assert head("node_ranges.csv") == f"{at},resp_start,resp_end,wrapped,stored_total,stored_min,stored_max"
    assert head("node_dump.csv") == f"{at},key,user,traj_id,lat,lon,datetime"
    hits = sum(39.2 <= 39 + k / 500 <= 39.6 and 115 + k / 200 <= 117.0 and 60 * k <= 30_000 for k in range(500))
    report = spark.read.option("header", True).csv(f"file://{first.path}/query_00_w/pnode_report.csv")
    assert report.agg(F.sum(F.col("returned_count").cast("long"))).first()[0] == hits
    assert report.filter("route_hops is null").isEmpty() == (mode != "snode")
    runs = run_dir.read_runs(spark, str(tmp_path / "out"))
    assert sorted((r.query, r.total_hits) for r in runs.collect()) == [("none", 0.0)] * 2 + [("w", float(hits))] * 2
    assert {r.total_hops is None for r in runs.filter("query = 'w'").collect()} == {mode == "snode"}
    (tmp_path / "out" / "run_x").mkdir()
    matrix = analytics.run_matrix(runs.filter(f"NOT (run = '{first.path.name}' AND query = 'none')"), "total_hits").collect()
    assert {r["query"]: r[first.path.name] for r in matrix} == {"w": hits, "none": None}
    loads = points.read_distribution(spark, f"file://{first.path}/node_distribution.csv")
    assert loads.agg(F.sum("total_count")).first()[0] == 500
    assert analytics.observed_nodes(loads).first().n_nodes == 8
    told = (first.path / "query_00_w/window.txt").read_text()
    assert int(told.split("n_raw_ranges: ")[1].split()[0]) >= 1
    assert tuple(points.skipped(spark.read.option("header", True).csv(config.input)).first()) == (502, 2)


def test_cleaning_a_folder(spark, tmp_path):
    def write(user, stem, rows):
        folder = tmp_path / f"raw/{user}/Trajectory"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{stem}.plt").write_text("h\n" * 6 + "".join(f"{a},{b},0,492,39744.1,{d},{t}\r\n" for a, b, d, t in rows))

    day = "2008-10-23"
    good = [(39.9 + k / 1000, 116.3, day, f"10:{k:02}:00") for k in range(8)]
    write("000", "a", [*good, good[3], (0, 0, day, "10:20:00"), (39.9, "x", day, "10:21:00"), (45.0, 116.3, day, "10:22:00"), (39.9, 116.3, "soon", "10:22:00"), (39.9, 116.3, "2001-01-01", "10:22:00")])
    write("000", "b", [*good[:5], (40.8, 116.3, day, "10:04:30"), (39.904000001, 116.3, day, "10:04:01")])
    write("001", "c", good[:3])
    write("001", "d", [(45.0, 116.3, day, "10:00:00")])
    row = cleaning.clean_folder(spark, str(tmp_path / "raw"), f"file://{tmp_path}/out").first().asDict()
    cut = cleaning.clean_folder(spark, str(tmp_path / "raw"), f"file://{tmp_path}/cut", kind="parquet", slice_s=90).first().asDict()
    assert cut == row
    assert spark.read.parquet(f"file://{tmp_path}/cut/clean").count() == 13
    counts = {k: row[k] for k in row if k.startswith(("files", "rows", "traj"))}
    assert counts == {
        "files_total": 4, "rows_total": 25, "rows_bad_format": 1, "rows_bad_time": 1, "rows_zero_coord": 1, "rows_out_of_bbox": 2, "rows_out_of_timerange": 1, "rows_same_second_merged": 1,
        "rows_speed_outlier": 1, "rows_too_close": 1, "traj_total": 3, "traj_too_short": 1,
    }
    table = spark.read.option("header", True).csv(f"file://{tmp_path}/out/clean")
    assert table.columns == ["user", "traj_id", "lat", "lon", "datetime"]
    assert table.groupBy("traj_id").count().orderBy("traj_id").collect() == [("000/a", 8), ("000/b", 5)]
    assert table.filter("traj_id = '000/a'").agg(F.min("datetime")).first()[0] == "2008-10-23T02:00:00Z"
    lines = {r.name: r.number for r in points.read_summary_text(spark, f"file://{tmp_path}/out/summary").collect()}
    assert lines["rows_total"] == 25
    assert lines["lat_min"] == 39.9


def test_runs_of_the_grid_that_are_missing_are_nulls(spark):
    names = analytics.grid_runs()
    assert len(names) == 17
    assert names[:3] == ["op128", "snode128", "p128v10"]
    assert "p8192v10000" not in names
    runs = spark.createDataFrame([("op128", "w", 5.0, 2.0, 9.0), ("p128v10", "w", 7.0, 4.0, None), ("other", "w", 1.0, 1.0, 1.0)], "run string, query string, total_hits double, hit_pnodes double, total_hops double")
    got = {r["query"]: r for r in analytics.run_matrix(runs, "total_hits", names, ["w", "v"]).collect()}
    assert list(got["w"].asDict()) == ["query", *names]
    assert [got["w"][n] for n in names[:3]] == [5.0, None, 7.0]
    assert set(got["v"][1:]) == {None}
    assert tuple(analytics.metric_scale(runs).first()) == (4.0, 9.0, 4.0 / 9.0)
    assert tuple(analytics.metric_scale(runs.filter("run = 'p128v10'")).first()) == (4.0, None, 1.0)


def test_where_the_configuration_is_looked_for(monkeypatch):
    monkeypatch.delenv("CONFIG", raising=False)
    assert config_path([]) == "config.yaml"
    monkeypatch.setenv("CONFIG", "env.yaml")
    assert (config_path([]), config_path(["arg.yaml", "x"])) == ("env.yaml", "arg.yaml")


def test_a_cap_takes_the_first_rows_of_the_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("lat,lon,time,user,tid\n" + "".join(f"{39 + k / 1e6},116,{k % 3},u,t\n" for k in range(3000)))
    got = points.read_clean_csv(spark, str(tmp_path / "in.csv"), 100).collect()
    assert sorted(round((r.lat - 39) * 1e6) for r in got) == list(range(100))
    ordered = clean.with_ordinal(points.read_clean_csv(spark, str(tmp_path / "in.csv")), "t", "place").orderBy("segment_id").collect()
    assert [round((r.lat - 39) * 1e6) for r in ordered] == sorted(range(3000), key=lambda k: (k % 3, k))


def test_names_of_magnitudes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 999.0, 1500.0, 2.5e6, 3e9, 4e12, 5e15)], "v double")
    assert [r.s for r in df.select(analytics.human("v").alias("s")).collect()] == ["0", "999", "1.5K", "2.5M", "3.0B", "4.0T", "5.0P"]


def test_cleaning_takes_one_shuffle(spark):
    raw = spark.createDataFrame([("a", 1, 39.9, 116.3, "2008-10-23", "10:00:00")], "traj_id string, ordinal long, lat double, lon double, date string, time string")
    plan = plan_of(clean.kept(clean.tag(raw)))
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_a_large_raw_file_is_read_by_many_tasks(spark, tmp_path):
    """Headers go, blank lines go, bad lines stay as nulls, and the order of lines is kept over the borders of splits."""
    for user, n in (("000", 20_000), ("001", 3)):
        (tmp_path / f"raw/{user}/Trajectory").mkdir(parents=True)
        body = [f"{39 + k / 1e5:.5f},116,0,492,39744.1,2008-10-23,{k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}" if k % 1000 != 7 else "bad line" for k in range(n)]
        (tmp_path / f"raw/{user}/Trajectory/a.plt").write_bytes("\r\n".join([*["1,2,3,4,5,6,7"] * 6, *body[: n // 2], "", *body[n // 2 :], ""]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = points.read_plt(spark, str(tmp_path / "raw"))
        assert rows.rdd.getNumPartitions() > 10
        got = {u: [(r.ordinal, r.lat) for r in rows.filter(f"user = '{u}'").orderBy("ordinal").collect()] for u in ("000", "001")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({o for o, _ in got["000"]}) == len(got["000"]) == 20_000
    assert [x for _, x in got["000"]] == [None if k % 1000 == 7 else round(39 + k / 1e5, 5) for k in range(20_000)]
    assert [x for _, x in got["001"]] == [39.0, 39.00001, 39.00002]


def test_account_is_observed_in_the_job_that_writes(spark, small, tmp_path):
    from curvespace import queries

    tagged = clean.tag(queries.raw(spark, small), queries.RULES)
    rows, seen = cleaning.observed(tagged)
    rows.filter("reason is null").write.parquet(f"file://{tmp_path}/clean")
    want = cleaning.account(tagged).first().asDict()
    assert {k: seen.get[k] for k in want} == want


def test_one_trajectory_of_a_third_of_all_rows_is_cut(spark):
    """Equal to whole trajectories, with ties, rows without a time and gaps over the borders of pieces."""
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        traj = "hot" if k % 3 == 0 else f"t{k % 60}" if k % 7 else None
        sec = rng.randrange(20_000)
        lat = rng.choice([39.9 + rng.randrange(5) / 1000, 39.9, 0.0, None, 50.0])
        rows.append((traj, k, lat, 0.0 if lat == 0.0 else 116.3, rng.choice(["2008-10-23"] * 9 + ["soon", None]), f"{10 + sec // 3600:02}:{sec // 60 % 60:02}:{sec % 60:02}"))
    raw = spark.createDataFrame(rows, "traj_id string, ordinal long, lat double, lon double, date string, time string")
    rules = clean.CleanRules(max_kmh=5.0, min_metres=50.0, min_seconds=600, min_points=4)
    whole = clean.tag(raw, rules)
    for seconds in (60, 3600):
        cut = clean.tag(raw, rules, seconds)
        assert sorted(cut.columns) == sorted(whole.columns)
        assert cut.select(*whole.columns).exceptAll(whole).isEmpty()
        assert cut.count() == whole.count() == 1500
    pieces = raw.filter("traj_id = 'hot'").select((F.unix_seconds(F.to_timestamp(F.concat_ws(" ", F.lit("2008-10-23"), "time"))) / 60).cast("long")).distinct().count()
    assert pieces > 100


def test_hops_end_on_their_own(spark):
    ring = spark.createDataFrame([(i, i, 8 * i) for i in range(100)], "pnode_idx long, vnode_idx long, node_id long")
    got = routing.hops_on(ring, spark.createDataFrame([(k,) for k in (5, 790)], "key long"), 10)
    assert all(1 <= r.hops <= 10 for r in got.collect())
