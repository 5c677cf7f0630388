"""Registered queries of the trajectory operators over the test tables, each with DuckDB SQL of another shape."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespace.functions import curves, fnv1a64, hilbert_xy, parse_seconds, rfc3339, sql, trajectory_id, unsigned_text
from curvespace.operators import clean, cover, placement, range_join, routing, window_query
from curvespace.params import Placement, SfcParams, Window
from curvespace.plans import analytics, cleaning
from curvespace.sources.keyed_store import KeyedStore
from curvespace.sources.points import pts_events, pts_lineitem
from curvespace.sources.shared import keep, shared_dir
from curvespace.streaming import clean as stream

Query = Callable[[SparkSession, str], DataFrame]

TIME = (1_704_067_200, 1_706_659_200)
PARAMS = {a: SfcParams(a, time=TIME) for a in ("z3", "h3", "z2t", "h2t")}
Z3 = PARAMS["z3"]
RING = Z3.ring_bits
WINDOWS = {
    "dense": Window("dense", 39.0, 39.1, 115.0, 116.0, 1_704_326_400, 1_704_931_200),
    "medium": Window("medium", 39.2, 39.4, 115.6, 117.0, 1_704_326_400, 1_704_931_200),
    "sparse": Window("sparse", 39.6, 40.4, 116.0, 117.8, 1_704_326_400, 1_704_931_200),
}
SMALL = (Window("small", 39.1, 39.12, 115.5, 115.53, 1_704_326_400, 1_704_330_000), Window("strip", 39.0, 39.3, 115.9, 115.93, 1_704_326_400, 1_704_400_000))
MODES = {"baseline": Placement("baseline", 64), "vnode": Placement("vnode", 16, 8), "snode": Placement("snode", 64, low_ratio=0.99, high_ratio=1.05)}

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def keyed(spark: SparkSession, sf_dir: str, p: SfcParams = Z3) -> DataFrame:
    return pts_events(spark, sf_dir).withColumn("key", curves.encode(p, F.col("lat"), F.col("lon"), F.col("t")))


# ---- SQL pieces: bit by bit where the engine spreads by masks ------------------------------------------------------

D = "CAST({} AS DOUBLE)".format
PTS = f"""pts AS (
  SELECT CAST(user_id AS VARCHAR) AS "user", CAST(user_id AS VARCHAR) AS traj_id, event_id AS ordinal, {D(39.0)} + value / {D(300.0)} AS lat,
         {D(115.0)} + CAST(json_extract_string(props, '$.k') AS BIGINT) * {D(3.0)} / {D(100.0)} AS lon, epoch_us(ts) // 1000000 AS t FROM events)"""


def sql_cell(v: str, low: float, high: float, floor: bool) -> str:
    return f"CAST({'floor' if floor else 'round'}(greatest(least(({D(v)} - {D(low)}) / {D(high - low)}, {D(1)}), {D(0)}) * {D(1023)}) AS BIGINT)"


def sql_spread(v: str, bits: int, step: int, at: int) -> str:
    return "(" + " + ".join(f"((({v}) >> {i}) & 1) * {1 << (step * i + at)}" for i in range(bits)) + ")"


def sql_morton3(x: str, y: str, z: str, bits: int = 10) -> str:
    return f"CAST({sql_spread(x, bits, 3, 2)} + {sql_spread(y, bits, 3, 1)} + {sql_spread(z, bits, 3, 0)} AS BIGINT)"


def sql_cells(p: SfcParams) -> str:
    z = f"least(greatest(t - {p.time[0]}, 0) // {p.bucket_s}, {p.num_buckets - 1})" if p.bucketed else sql_cell("t", *p.time, p.floors)
    return f"SELECT *, {sql_cell('lat', *p.lat, p.floors)} AS x, {sql_cell('lon', *p.lon, p.floors)} AS y, {z} AS z FROM pts"


def sql_keyed(p: SfcParams = Z3) -> str:
    key = f"CAST(z * {1 << 20} + {sql_spread('x', 10, 2, 1)} + {sql_spread('y', 10, 2, 0)} AS BIGINT)" if p.bucketed else sql_morton3("x", "y", "z")
    return f"{PTS}, cells AS ({sql_cells(p)}), keyed AS (SELECT *, {key} AS key FROM cells)"


def sql_inside(w: Window) -> str:
    return f"lat BETWEEN {D(w.lat_min)} AND {D(w.lat_max)} AND lon BETWEEN {D(w.lon_min)} AND {D(w.lon_max)} AND t BETWEEN {w.t_start} AND {w.t_end}"


def sql_windows(windows: tuple[Window, ...]) -> str:
    rows = ", ".join(f"('{w.name}', {D(w.lat_min)}, {D(w.lat_max)}, {D(w.lon_min)}, {D(w.lon_max)}, CAST({w.t_start} AS BIGINT), CAST({w.t_end} AS BIGINT))" for w in windows)
    return f"win(name, lat_min, lat_max, lon_min, lon_max, t_start, t_end) AS (VALUES {rows})"


#: A window around the first point of every user.
SQL_WIN = f"""{PTS.replace("pts AS", "first AS", 1)}, win AS (SELECT 'u' || traj_id AS name, lat - {D(0.02)} AS lat_min, lat + {D(0.02)} AS lat_max, lon - {D(0.03)} AS lon_min, lon + {D(0.03)} AS lon_max, t - 1800 AS t_start, t + 5400 AS t_end
  FROM first QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY ordinal) = 1)"""


def sql_merge(source: str, into: str, by: str = "name", gap: int = 1) -> str:
    return f"""{into}_m AS (SELECT *, max(hi) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {source}),
{into}_i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY lo, hi) AS island FROM {into}_m),
{into} AS (SELECT {by}, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM {into}_i GROUP BY {by}, island)"""


def sql_cover(side: int = 4) -> str:
    """``cov(name, lo, hi)``: the blocks of ``side`` cells a side that meet each window of ``win``, one by one, and joined."""
    pad, n = Z3.time_pad, side**3
    corner = lambda a, b, c: f"{sql_cell(a, *Z3.lat, True)} // {side}, {sql_cell(b, *Z3.lon, True)} // {side}, {sql_cell(c, *Z3.time, True)} // {side}"
    return f"""{SQL_WIN},
box(name, x0, y0, z0, x1, y1, z1) AS (SELECT name, {corner('lat_min', 'lon_min', f't_start - {pad}')}, {corner('lat_max', 'lon_max', f't_end + {pad - 1}')} FROM win),
blk AS (SELECT name, {sql_morton3('x', 'y', 'z')} AS block FROM box, unnest(range(x0, x1 + 1)) a(x), unnest(range(y0, y1 + 1)) b(y), unnest(range(z0, z1 + 1)) c(z)),
rng AS (SELECT name, block * {n} AS lo, block * {n} + {n - 1} AS hi FROM blk),
{sql_merge('rng', 'cov')}"""


def sql_coalesced(prefix: int) -> str:
    size = 1 << (RING - prefix)
    return f"""{sql_cover()},
hull AS (SELECT name, min(greatest(lo, p * {size})) AS lo, max(least(hi, p * {size} + {size - 1})) AS hi FROM (SELECT *, unnest(range(lo // {size}, hi // {size} + 1)) AS p FROM cov) GROUP BY name, p),
{sql_merge('hull', 'coal')}"""


SQL_ANCHORS = f"""spot AS (
  SELECT name, (lat_min + lat_max) * {D(0.5)} AS lat, (lon_min + lon_max) * {D(0.5)} AS lon, t_start, t_end FROM win
  UNION ALL SELECT name, a, b, t_start, t_end FROM win, unnest([lat_min, lat_max]) x(a), unnest([lon_min, lon_max]) y(b)),
pts AS (SELECT name, lat, lon, t FROM spot, unnest([t_start, t_end - 1]) z(t)), cells AS ({sql_cells(Z3)}),
anc AS (SELECT name, {sql_morton3('x', 'y', 'z')} // 64 * 64 AS lo, {sql_morton3('x', 'y', 'z')} // 64 * 64 + 63 AS hi FROM cells)"""


def sql_node(key: str, n: int) -> str:
    s = placement.spacing(n, RING)
    return f"CAST(CASE WHEN ceil({key} / {D(s)}) >= {n} THEN 0 ELSE ceil({key} / {D(s)}) END AS BIGINT)"


def sql_hops(key: str, n: int) -> str:
    s = placement.spacing(n, RING)
    return f"CAST(bit_count(CASE WHEN {key} = 0 OR {key} > {(n - 1) * s} THEN {n - 1} ELSE CAST(ceil({key} / {D(s)}) AS BIGINT) - 1 END) + 1 AS BIGINT)"


def sql_ring(nodes: int, vnodes: int) -> str:
    n = nodes * vnodes
    s = placement.spacing(n, RING)
    return f"""ring AS (SELECT CAST(i % {nodes} AS BIGINT) AS pnode_idx, CAST(i AS BIGINT) AS vnode_idx, CAST(i * {s} AS BIGINT) AS node_id,
  CAST(coalesce(lag(i * {s}) OVER (ORDER BY i), {(n - 1) * s}) + 1 AS BIGINT) AS resp_start, CAST(i * {s} AS BIGINT) AS resp_end, i = 0 AS wrapped FROM range({n}) r(i))"""


def sql_distribution(nodes: int, vnodes: int) -> str:
    return f"""{sql_keyed()}, {sql_ring(nodes, vnodes)},
held AS (SELECT {sql_node('key', nodes * vnodes)} AS v, count(*) AS c, min(key // 64 * 64) AS a, max(key // 64 * 64) AS b FROM keyed GROUP BY 1),
dist AS (SELECT ring.*, coalesce(c, 0) AS total_count, a AS min_key, b AS max_key FROM ring LEFT JOIN held ON v = vnode_idx)"""


def sql_packed(keyed: str, nodes: int, low: float, high: float, order: str) -> str:
    """Packing row by row: ``quota`` counts the rows that a node which has enough still takes (-1: it has not enough)."""
    mean = f"((SELECT count(*) FROM {keyed}) / {D(nodes)})"
    return f"""lim AS (SELECT greatest(1, CAST(floor({mean} * {D(low)}) AS BIGINT)) AS lo, CAST(ceil({mean} * {D(high)}) AS BIGINT) AS hi),
line AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, {order}) AS i, key, {order}, row_number() OVER (PARTITION BY key ORDER BY {order}) = 1 AS opens, count(*) OVER (PARTITION BY key) - row_number() OVER (PARTITION BY key ORDER BY {order}) + 1 AS rest FROM {keyed}),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS acc, CAST(-1 AS BIGINT) AS quota
  UNION ALL
  SELECT i, cur, CASE WHEN q = 1 OR (q < 0 AND acc + 1 >= hi AND rest > 1) THEN cur + 1 ELSE cur END, CASE WHEN q = 1 OR (q < 0 AND acc + 1 >= hi AND rest > 1) THEN 0 ELSE acc + 1 END, CASE WHEN q > 1 THEN q - 1 ELSE -1 END
  FROM (SELECT line.i, line.rest, walk.cur, walk.acc, lim.hi, CASE WHEN walk.quota > 0 THEN walk.quota WHEN line.opens AND walk.acc >= lim.lo THEN CASE WHEN walk.acc + line.rest <= lim.hi THEN line.rest ELSE least(greatest(lim.hi - walk.acc, 1), line.rest) END ELSE -1 END AS q
        FROM walk JOIN line ON line.i = walk.i + 1, lim) s),
placed AS (SELECT line.key, line.{order}, least(walk.node, {nodes - 1}) AS node FROM walk JOIN line USING (i))"""


SQL_SNODE = f"""{sql_keyed()}, {sql_packed('keyed', 64, 0.99, 1.05, 'ordinal')}"""
SQL_LOAD = f"WITH {sql_distribution(64, 1)}, ld AS (SELECT pnode_idx, CAST(sum(total_count) AS BIGINT) AS total_count FROM dist GROUP BY 1)"


# ---- keys ------------------------------------------------------------------------------------------------------------


def _encode(p: SfcParams) -> Query:
    return lambda spark, sf: keyed(spark, sf, p).select("ordinal", "key")


for _a, _p in PARAMS.items():
    register(f"encode_{_a}", f"WITH {sql_keyed(_p)} SELECT ordinal, key FROM keyed")(_encode(_p))

_LINE = SfcParams("z3", time=(789_004_800, 1_004_832_000))


@register("encode_z3_lineitem", None)
def encode_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = pts_lineitem(spark, sf_dir)
    node = placement.assign(pts.withColumn("key", curves.encode(_LINE, F.col("lat"), F.col("lon"), F.col("t"))), _LINE, Placement("baseline", 128))
    return node.groupBy("pnode_idx").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


ORACLE["encode_z3_lineitem"] = f"""
WITH pts AS (SELECT {D(39.0)} + l_extendedprice / {D(60000.0)} AS lat, {D(115.0)} + l_suppkey * {D(3.0)} / {D(1000.0)} AS lon, epoch_us(l_shipdate) // 1000000 AS t FROM lineitem),
cells AS ({sql_cells(_LINE)}), keyed AS (SELECT *, {sql_morton3('x', 'y', 'z')} AS key FROM cells)
SELECT {sql_node('key', 128)} AS pnode_idx, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM keyed GROUP BY 1"""


#: The cells of ``cell(id, x, y)``, walked down level by level: place so far, axes exchanged, axes backwards.
SQL_HILBERT = """walk AS (
  SELECT id, x, y, 9 AS i, CAST(0 AS BIGINT) AS d, 0 AS swap, 0 AS back FROM cell
  UNION ALL
  SELECT id, x, y, i - 1, d * 4 + xor(3 * p, q), CASE WHEN q = 0 THEN 1 - swap ELSE swap END, CASE WHEN q = 0 AND p = 1 THEN 1 - back ELSE back END
  FROM (SELECT *, xor(CASE WHEN swap = 1 THEN (y >> i) & 1 ELSE (x >> i) & 1 END, back) AS p, xor(CASE WHEN swap = 1 THEN (x >> i) & 1 ELSE (y >> i) & 1 END, back) AS q FROM walk WHERE i >= 0)
), hilbert AS (SELECT id, d FROM walk WHERE i = -1)"""
HILBERT = SfcParams("h2t", time=TIME, true_hilbert=True)


@register("hilbert_keys", f"""WITH RECURSIVE {PTS}, cells AS ({sql_cells(HILBERT)}), cell AS (SELECT ordinal AS id, x, y FROM cells), {SQL_HILBERT}
SELECT ordinal, CAST(z * {1 << 20} + d AS BIGINT) AS key FROM cells JOIN hilbert ON id = ordinal""")
def hilbert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir, HILBERT).select("ordinal", "key")


@register("hilbert_path", f"WITH {PTS}, cells AS ({sql_cells(HILBERT)}) SELECT ordinal, x, y FROM cells")
def hilbert_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all points, found again from their places along the curve."""
    x, y = hilbert_xy(F.col("key") % (1 << 20), 10)
    return keyed(spark, sf_dir, HILBERT).select("ordinal", x.alias("x"), y.alias("y"))


@register("density_pyramid", f"WITH {sql_keyed()} " + " UNION ALL ".join(f"SELECT {n} AS level, CAST(key >> {30 - 3 * n} AS BIGINT) AS cell, count(*) AS n FROM keyed GROUP BY 2" for n in (1, 2, 4, 6, 8, 10)))
def density_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.density_pyramid(keyed(spark, sf_dir), Z3, (1, 2, 4, 6, 8, 10))


@register("fnv_hash", f"""WITH {PTS}, u AS (SELECT DISTINCT traj_id FROM pts)
SELECT traj_id, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(traj_id, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS hash FROM u""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts_events(spark, sf_dir).select("traj_id").distinct().select("traj_id", unsigned_text(fnv1a64(F.col("traj_id"))).alias("hash"))


@register("trajectory_ids", f"""WITH {PTS}, n AS (SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN traj_id ELSE "user" || '_' || strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS s FROM pts)
SELECT ordinal, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS traj_hash FROM n""")
def trajectory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = pts_events(spark, sf_dir)
    named = F.when(F.col("ordinal") % 4 == 0, F.col("traj_id")).otherwise("")
    return pts.select("ordinal", unsigned_text(trajectory_id(F.col("user"), named, rfc3339(F.col("t")))).alias("traj_hash"))


@register("parse_time_variants", f"""WITH {PTS} SELECT ordinal,
  CASE ordinal % 6 WHEN 5 THEN 0 WHEN 3 THEN t // 86400 * 86400 ELSE t END AS t FROM pts""")
def parse_time_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = pts_events(spark, sf_dir)
    ts, k = F.timestamp_seconds("t"), F.col("ordinal") % 6
    forms = [F.col("t").cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy/MM/dd HH:mm:ss")]
    text = F.lit("not a time")
    for i, f in enumerate(forms):
        text = F.when(k == i, f).otherwise(text)
    return pts.select("ordinal", parse_seconds(text).alias("t"))


# ---- windows ---------------------------------------------------------------------------------------------------------


def _window(w: Window) -> Query:
    return lambda spark, sf: window_query.window_query(pts_events(spark, sf), w).select("ordinal", "traj_id", "lat", "lon", rfc3339(F.col("t")).alias("datetime"))


for _w in WINDOWS.values():
    register(f"window_{_w.name}", f"WITH {PTS} SELECT ordinal, traj_id, lat, lon, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS datetime FROM pts WHERE {sql_inside(_w)}")(_window(_w))


@register("window_sql", f"WITH {PTS} SELECT ordinal, traj_id, lat, lon FROM pts WHERE {sql_inside(WINDOWS['medium'])}")
def window_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window in plain SQL: the cover as a table function, keys as a scalar one."""
    w = WINDOWS["medium"]
    sql.register(spark, Z3)
    box = f"{w.lat_min}D, {w.lat_max}D, {w.lon_min}D, {w.lon_max}D, {w.t_start}L, {w.t_end}L"
    return spark.sql(f"""SELECT ordinal, traj_id, lat, lon FROM {{points}} p LEFT SEMI JOIN sfc_cover({box}, 18) c ON sfc_key(p.lat, p.lon, p.t) BETWEEN c.lo AND c.hi
WHERE lat BETWEEN {w.lat_min}D AND {w.lat_max}D AND lon BETWEEN {w.lon_min}D AND {w.lon_max}D AND t BETWEEN {w.t_start} AND {w.t_end}""", points=pts_events(spark, sf_dir))


@register("multi_window", f"WITH {PTS}, {sql_windows(tuple(WINDOWS.values()))} SELECT name, ordinal, lat, lon FROM pts JOIN win ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t BETWEEN t_start AND t_end")
def multi_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_query.multi_window(pts_events(spark, sf_dir), cover.windows_frame(spark, list(WINDOWS.values())), Z3).select("name", "ordinal", "lat", "lon")


def stored(spark: SparkSession, sf_dir: str) -> KeyedStore:
    """``events``, placed, in a keyed store of its own."""
    placed = placement.assign(keyed(spark, sf_dir), Z3, MODES["baseline"])
    return KeyedStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", Z3).append(placed)


for _w in WINDOWS.values():
    register(f"window_stored_{_w.name}", f"WITH {sql_keyed()} SELECT ordinal, key FROM keyed WHERE {sql_inside(_w)}")(lambda spark, sf, w=_w: stored(spark, sf).window(w).select("ordinal", "key"))


@register("windows_stored", f"WITH {SQL_WIN}, {PTS} SELECT name, ordinal FROM pts JOIN win ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t BETWEEN t_start AND t_end")
def windows_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).windows(windows(spark, sf_dir)).select("name", "ordinal")


register("node_stored", f"WITH {sql_keyed()} SELECT ordinal, key, CAST(key // 64 * 64 AS BIGINT) AS bucket FROM keyed WHERE {sql_node('key', 64)} = 17")(lambda spark, sf: stored(spark, sf).node(17).select("ordinal", "key", "bucket"))
register("buckets_stored", f"WITH {sql_keyed()} SELECT ordinal, key FROM keyed WHERE key // 64 * 64 <= 400000000 AND key // 64 * 64 + 63 >= 300000000")(lambda spark, sf: stored(spark, sf).buckets(300_000_000, 400_000_000).select("ordinal", "key"))


@register("points_in_ranges", f"WITH {sql_cover()}, {sql_keyed()} SELECT ordinal, key FROM keyed SEMI JOIN cov ON name = 'u' || traj_id AND key BETWEEN lo AND hi")
def points_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's points whose keys lie in the cover of the user's window, by merging."""
    points = keyed(spark, sf_dir).withColumn("name", F.concat(F.lit("u"), "traj_id"))
    return range_join.in_ranges(points, cover.cover(windows(spark, sf_dir), Z3)).select("ordinal", "key")


@register("distinct_hits", f"WITH {sql_keyed()}, {sql_windows(tuple(WINDOWS.values()))} SELECT name, count(DISTINCT (traj_id, t, key)) AS distinct_hits FROM keyed JOIN win ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t BETWEEN t_start AND t_end GROUP BY name")
def distinct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = window_query.multi_window(keyed(spark, sf_dir), cover.windows_frame(spark, list(WINDOWS.values())), Z3)
    return window_query.distinct_hits(hits, ("traj_id", "t", "key"))


@register("window_hits_by_placement", "WITH " + PTS + ", modes(mode) AS (VALUES ('baseline'), ('vnode'), ('snode')) SELECT mode, name, n_hits FROM modes, (" + " UNION ALL ".join(f"SELECT '{w.name}' AS name, count(*) AS n_hits FROM pts WHERE {sql_inside(w)}" for w in WINDOWS.values()) + ")")
def hits_by_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placement answers by the nodes of its own fetch plan."""
    pts, wins = keyed(spark, sf_dir), cover.windows_frame(spark, list(WINDOWS.values()))
    plan = keep(cover.plan_windows(wins, Z3))
    out = None
    for mode, place in MODES.items():
        placed = placement.assign(pts, Z3, place, [F.col("ordinal")])
        nodes = window_query.fetch_plan_on(plan, placement.snode_ring(placed, place), RING) if mode == "snode" else window_query.fetch_plan(plan, place, RING)
        got = window_query.fetch(placed, wins, nodes, Z3).groupBy("name").agg(F.count(F.lit(1)).alias("n_hits")).select(F.lit(mode).alias("mode"), "name", "n_hits")
        out = got if out is None else out.unionByName(got)
    return out


# ---- covers ----------------------------------------------------------------------------------------------------------


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around the first point of every user."""
    first = pts_events(spark, sf_dir).groupBy("traj_id").agg(*[F.min_by(c, "ordinal").alias(c) for c in ("lat", "lon", "t")])
    around = lambda c, by: [(F.col(c) - by).alias(f"{c}_min"), (F.col(c) + by).alias(f"{c}_max")]
    return first.select(F.concat(F.lit("u"), "traj_id").alias("name"), *around("lat", 0.02), *around("lon", 0.03), (F.col("t") - 1800).alias("t_start"), (F.col("t") + 5400).alias("t_end"))


register("cover_ranges", f"WITH {sql_cover()} SELECT name, lo, hi FROM cov")(lambda spark, sf: cover.cover(windows(spark, sf), Z3))
register("cover_stats", f"WITH {sql_cover()} SELECT name, count(*) AS n_ranges, CAST(sum(hi - lo + 1) AS BIGINT) AS n_keys FROM cov GROUP BY name")(lambda spark, sf: cover.plan_stats(cover.cover(windows(spark, sf), Z3)))
register("cover_mixed", f"WITH {sql_cover(1)} SELECT name, lo, hi FROM cov")(lambda spark, sf: cover.fine_cover(windows(spark, sf), Z3))
register("cover_best", f"""WITH {sql_cover(1)}, gap AS (SELECT *, lo - lag(hi) OVER (PARTITION BY name ORDER BY lo) AS gap FROM cov),
wide AS (SELECT *, CAST(gap IS NOT NULL AND row_number() OVER (PARTITION BY name ORDER BY gap DESC NULLS LAST, lo) < 8 AS INTEGER) AS cut FROM gap), run AS (SELECT *, sum(cut) OVER (PARTITION BY name ORDER BY lo) AS run FROM wide)
SELECT name, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM run GROUP BY name, run""")(lambda spark, sf: cover.fine_cover(windows(spark, sf), Z3, most=8))
register("cover_hilbert", f"""WITH RECURSIVE {SQL_WIN},
box(name, x0, y0, z0, x1, y1, z1) AS (SELECT name, {sql_cell('lat_min', *Z3.lat, False)}, {sql_cell('lon_min', *Z3.lon, False)}, greatest(t_start - {TIME[0]}, 0) // 3600,
  {sql_cell('lat_max', *Z3.lat, False)}, {sql_cell('lon_max', *Z3.lon, False)}, least((t_end - {TIME[0]}) // 3600, {HILBERT.num_buckets - 1}) FROM win),
sq AS (SELECT name, x, y, z0, z1 FROM box, unnest(range(x0, x1 + 1)) a(x), unnest(range(y0, y1 + 1)) b(y)), cell AS (SELECT DISTINCT x * 1024 + y AS id, x, y FROM sq), {SQL_HILBERT},
rng AS (SELECT name, z * {1 << 20} + d AS lo, z * {1 << 20} + d AS hi FROM sq JOIN hilbert ON id = x * 1024 + y, unnest(range(z0, z1 + 1)) c(z)), {sql_merge('rng', 'cov')} SELECT name, lo, hi FROM cov""")(lambda spark, sf: cover.fine_cover(windows(spark, sf), HILBERT))
for _k in (18, 12):
    register(f"cover_coalesced_p{_k}", f"WITH {sql_coalesced(_k)} SELECT name, lo, hi FROM coal")(lambda spark, sf, k=_k: cover.coalesce_ranges(cover.cover(windows(spark, sf), Z3), k, RING))
register("anchor_blocks", f"WITH {SQL_WIN}, {SQL_ANCHORS} SELECT name, lo, hi FROM anc")(lambda spark, sf: cover.anchor_blocks(windows(spark, sf), Z3))
register("plan_ranges", f"WITH {sql_cover()}, {SQL_ANCHORS}, bth AS (SELECT name, lo, hi FROM cov UNION ALL SELECT name, lo, hi FROM anc), {sql_merge('bth', 'plan')} SELECT name, lo, hi FROM plan")(lambda spark, sf: cover.plan_windows(windows(spark, sf), Z3))
_Z2T = PARAMS["z2t"]
register("cover_z2t", f"""WITH {SQL_WIN},
box(name, x0, y0, z0, x1, y1, z1) AS (SELECT name, {sql_cell('lat_min', *Z3.lat, False)} // 4, {sql_cell('lon_min', *Z3.lon, False)} // 4, greatest(t_start - {TIME[0]}, 0) // 3600,
  {sql_cell('lat_max', *Z3.lat, False)} // 4, {sql_cell('lon_max', *Z3.lon, False)} // 4, least((t_end - {TIME[0]}) // 3600, {_Z2T.num_buckets - 1}) FROM win),
sq AS (SELECT name, z * {1 << 20} + 16 * ({sql_spread('x', 8, 2, 1)} + {sql_spread('y', 8, 2, 0)}) AS lo FROM box, unnest(range(x0, x1 + 1)) a(x), unnest(range(y0, y1 + 1)) b(y), unnest(range(z0, z1 + 1)) c(z)),
rng AS (SELECT name, lo, lo + 15 AS hi FROM sq), {sql_merge('rng', 'cov')} SELECT name, lo, hi FROM cov""")(lambda spark, sf: cover.cover(windows(spark, sf), PARAMS["z2t"], 4))
register("merge_keys_gap", f"WITH {sql_keyed()}, k AS (SELECT traj_id, key AS lo, key AS hi FROM keyed), {sql_merge('k', 'mk', 'traj_id', 100_000)} SELECT traj_id, lo, hi FROM mk")(lambda spark, sf: cover.merge_keys(keyed(spark, sf), ("traj_id",), 100_000))
register("split_wrapping", f"""WITH {sql_ring(8, 1)}, r AS (SELECT vnode_idx, CASE WHEN wrapped THEN [[resp_start, {2**RING - 1}], [0, resp_end]] ELSE [[resp_start, resp_end]] END AS p FROM ring)
SELECT vnode_idx, CAST(e[1] AS BIGINT) AS lo, CAST(e[2] AS BIGINT) AS hi FROM (SELECT vnode_idx, unnest(p) AS e FROM r)""")(lambda spark, sf: cover.split_wrapping(placement.ring(spark, Placement(nodes=8), RING).select("vnode_idx", F.col("resp_start").alias("lo"), F.col("resp_end").alias("hi")), 2**RING - 1))
register("covered_hours", f"""WITH {SQL_WIN} SELECT name, CAST((t_end - t_start) // 600 + 1 AS BIGINT) AS n_samples, CAST((t_end - t_start) // 600 + 1 AS BIGINT) AS n_covered FROM win""")(lambda spark, sf: cover.covered_hours(windows(spark, sf), cover.cover(windows(spark, sf), Z3), Z3, 600))


# ---- placement -------------------------------------------------------------------------------------------------------

register("ring_baseline", f"WITH {sql_ring(64, 1)} SELECT * FROM ring")(lambda spark, sf: placement.ring(spark, MODES["baseline"], RING))
register("ring_vnode", f"WITH {sql_ring(16, 8)} SELECT * FROM ring")(lambda spark, sf: placement.ring(spark, MODES["vnode"], RING))


def distribution(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    placed = placement.assign(keyed(spark, sf_dir), Z3, MODES[mode], [F.col("ordinal")])
    if mode == "snode":
        return placement.node_distribution(placed, placement.snode_ring(placed, MODES[mode]), exact=True)
    return placement.node_distribution(placed, placement.ring(spark, MODES[mode], RING))


register("node_distribution_baseline", f"WITH {sql_distribution(64, 1)} SELECT * FROM dist")(lambda spark, sf: distribution(spark, sf, "baseline"))
register("node_distribution_vnode", f"WITH {sql_distribution(16, 8)} SELECT * FROM dist")(lambda spark, sf: distribution(spark, sf, "vnode"))
register("vnode_rollup", f"""WITH {sql_distribution(16, 8)} SELECT pnode_idx, min(node_id) AS node_id, CAST(sum(total_count) AS BIGINT) AS total_count, min(min_key) AS min_key, max(max_key) AS max_key FROM dist GROUP BY pnode_idx""")(lambda spark, sf: placement.roll_up(distribution(spark, sf, "vnode")))
register("node_distribution_snode", f"""WITH RECURSIVE {SQL_SNODE}, held AS (SELECT node, count(*) AS c, min(key) AS a, max(key) AS b FROM placed GROUP BY node),
f AS (SELECT CAST(i AS BIGINT) AS i, c, a, b, coalesce(max(b) OVER (ORDER BY i), 0) AS e FROM range(64) r(i) LEFT JOIN held ON node = i)
SELECT i AS pnode_idx, i AS vnode_idx, e AS node_id, coalesce(lag(e) OVER (ORDER BY i), a, 0) AS resp_start, e AS resp_end, FALSE AS wrapped, coalesce(c, 0) AS total_count, a AS min_key, b AS max_key FROM f""")(lambda spark, sf: distribution(spark, sf, "snode"))
register("packed_long_runs", f"""WITH RECURSIVE {sql_keyed()}, runs AS (SELECT key >> 15 AS key, ordinal FROM keyed), {sql_packed('runs', 64, 0.95, 1.10, 'ordinal')}
SELECT CAST(node AS BIGINT) AS pnode_idx, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM placed GROUP BY node""")(lambda spark, sf: placement.assign(keyed(spark, sf).withColumn("key", F.shiftright("key", 15)), Z3, Placement("snode", 64), [F.col("ordinal")]).groupBy("pnode_idx").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key")))
register("bucket_probe", f"WITH {sql_keyed()} SELECT ordinal, key FROM keyed WHERE key // 4096 * 4096 <= 400000000 AND key // 4096 * 4096 + 4095 >= 300000000")(lambda spark, sf: placement.bucket_probe(keyed(spark, sf), 300_000_000, 400_000_000, 12).select("ordinal", "key"))


# ---- routing and fetch cost --------------------------------------------------------------------------------------------


@register("hops_uniform", f"WITH {sql_keyed()}, n(n) AS (VALUES (8), (128), (1024)) SELECT CAST(n AS BIGINT) AS n, ordinal, CASE n WHEN 8 THEN {sql_hops('key', 8)} WHEN 128 THEN {sql_hops('key', 128)} ELSE {sql_hops('key', 1024)} END AS hops FROM keyed, n")
def hops_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = keyed(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), routing.hops(F.col("key"), n, RING).alias("hops")) for n in (8, 128, 1024)])
    return pts.select("ordinal", F.inline(each)).select("n", "ordinal", "hops")


register("fingers_uniform", f"""WITH {sql_ring(64, 1)}, k(k) AS (SELECT CAST(i AS INTEGER) FROM range({RING}) r(i)), t AS (SELECT vnode_idx, k, node_id + CAST(1 AS BIGINT) * (1::BIGINT << k) AS target FROM ring, k)
SELECT vnode_idx, k, target, {sql_node('target', 64)} AS finger_idx FROM t""")(lambda spark, sf: routing.fingers(placement.ring(spark, MODES["baseline"], RING), RING))


@register("hops_snode", None)
def hops_snode(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placement.assign(keyed(spark, sf_dir), Z3, MODES["snode"], [F.col("ordinal")])
    ring = placement.snode_ring(placed, MODES["snode"])
    reps = window_query.fetch_plan_on(cover.cover(windows(spark, sf_dir), Z3), ring, RING).groupBy("name", "pnode_idx").agg(F.min("lo").alias("key"))
    return routing.hops_on(ring, reps.select("key"), RING)


_BASE = MODES["baseline"]
SQL_PLAN = f"""{sql_cover()}, {SQL_ANCHORS.replace('pts AS', 'apts AS').replace('FROM pts', 'FROM apts').replace('cells AS', 'acells AS').replace('FROM cells', 'FROM acells')},
bth AS (SELECT name, lo, hi FROM cov UNION ALL SELECT name, lo, hi FROM anc), {sql_merge('bth', 'plan')}, {sql_ring(64, 1)},
arc AS (SELECT pnode_idx, vnode_idx, resp_start AS s, CASE WHEN wrapped THEN {2**62} ELSE resp_end END AS e FROM ring UNION ALL SELECT pnode_idx, vnode_idx, 0, resp_end FROM ring WHERE wrapped),
met AS (SELECT name, pnode_idx, vnode_idx, greatest(lo, s) AS lo, least(hi, e) AS hi FROM plan JOIN arc ON lo <= e AND s <= hi), {sql_merge('met', 'slice', 'name, pnode_idx, vnode_idx')}"""
SQL_REPORT = f"""{SQL_PLAN}, {sql_keyed()}, hit AS (SELECT name, {sql_node('key', 64)} AS p FROM keyed JOIN win ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t BETWEEN t_start AND t_end),
rep AS (SELECT name, pnode_idx, min(lo) AS key FROM slice GROUP BY 1, 2),
report AS (SELECT rep.name, pnode_idx, (SELECT count(*) FROM hit WHERE hit.name = rep.name AND p = pnode_idx) AS returned_count, {sql_hops('key', 64)} AS route_hops FROM rep)"""

register("fetch_plan", f"WITH {SQL_PLAN} SELECT name, pnode_idx, vnode_idx, lo, hi FROM slice")(lambda spark, sf: window_query.fetch_plan(cover.plan_windows(windows(spark, sf), Z3), _BASE, RING))


def report(spark: SparkSession, sf: str) -> DataFrame:
    return window_query.window_report(placement.assign(keyed(spark, sf), Z3, _BASE), windows(spark, sf), Z3, _BASE)


register("pnode_report", f"WITH {SQL_REPORT} SELECT * FROM report")(report)
register("query_summary", f"WITH {SQL_REPORT} SELECT name, CAST(sum(returned_count) AS BIGINT) AS total_hits, count(*) AS hit_pnodes, CAST(sum(route_hops) AS BIGINT) AS total_hops, round(avg(route_hops), 3) AS avg_hops FROM report GROUP BY name")(lambda spark, sf: window_query.query_summary(report(spark, sf)))


# ---- trajectories and cleaning ----------------------------------------------------------------------------------------

RULES = clean.CleanRules(time=(TIME[0] + 86_400, TIME[1]), lat=(39.0, 39.5), max_kmh=20.0, min_metres=5000.0, min_seconds=7200, min_points=20)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ``events`` as raw local rows, some of them broken."""
    local = F.timestamp_seconds(F.col("t") + 28_800)
    o = F.col("ordinal")
    return pts_events(spark, sf_dir).select(
        "traj_id", "ordinal", F.when(o % 97 == 0, 0.0).when(o % 101 != 0, F.col("lat")).alias("lat"), F.when(o % 97 == 0, 0.0).otherwise(F.col("lon")).alias("lon"),
        F.when(o % 103 == 0, "n/a").otherwise(F.date_format(local, "yyyy-MM-dd")).alias("date"), F.date_format(local, "HH:mm:ss").alias("time"),
    )


def sql_dist(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))"


SQL_CLEAN = f"""{PTS}, raw AS (SELECT traj_id, ordinal, t, CASE WHEN ordinal % 97 = 0 THEN 0.0 WHEN ordinal % 101 <> 0 THEN lat END AS lat, CASE WHEN ordinal % 97 = 0 THEN 0.0 ELSE lon END AS lon FROM pts),
s1 AS (SELECT *, CASE WHEN lat IS NULL THEN 'bad_format' WHEN lat = 0 AND lon = 0 THEN 'zero_coord' WHEN ordinal % 103 = 0 THEN 'bad_time' WHEN t < {RULES.time[0]} OR t >= {RULES.time[1]} THEN 'out_of_time'
  WHEN lat NOT BETWEEN 39.0 AND 39.5 OR lon NOT BETWEEN 115.0 AND 118.0 THEN 'out_of_bbox' END AS r FROM raw),
s2 AS (SELECT * EXCLUDE (r), coalesce(r, CASE WHEN row_number() OVER (PARTITION BY traj_id, r, t, lat, lon ORDER BY ordinal) > 1 THEN 'same_second' END) AS r FROM s1),
ok AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(t) OVER w AS pt FROM s2 WHERE r IS NULL WINDOW w AS (PARTITION BY traj_id ORDER BY t, ordinal)),
sp AS (SELECT traj_id, ordinal, {sql_dist('plat', 'plon', 'lat', 'lon')} AS d, t - pt AS g FROM ok),
s3 AS (SELECT s2.* EXCLUDE (r), d, coalesce(r, CASE WHEN d / greatest(1.0, g) * 3.6 > 20.0 THEN 'speed' WHEN d < 5000.0 AND g < 7200 THEN 'too_close' END) AS r FROM s2 LEFT JOIN sp USING (traj_id, ordinal)),
tagged AS (SELECT * EXCLUDE (r), coalesce(r, CASE WHEN count(*) FILTER (r IS NULL) OVER (PARTITION BY traj_id) < 20 THEN 'too_short' END) AS reason FROM s3)"""

register("clean_kept", f"WITH {SQL_CLEAN} SELECT traj_id, ordinal, lat, lon, round(d, 3) AS dist_m, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS datetime FROM tagged WHERE reason IS NULL")(lambda spark, sf: clean.kept(clean.tag(raw(spark, sf), RULES)).select("traj_id", "ordinal", "lat", "lon", F.round("dist_m", 3).alias("dist_m"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime")))
register("clean_sliced", ORACLE["clean_kept"])(lambda spark, sf: clean.kept(clean.tag(raw(spark, sf), RULES, slice_s=6 * 3600)).select("traj_id", "ordinal", "lat", "lon", F.round("dist_m", 3).alias("dist_m"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime")))
@register("clean_stream", f"WITH {SQL_CLEAN} SELECT traj_id, ordinal, round(d, 3) AS dist_m, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY t, ordinal) - 1 AS INTEGER) AS segment_id FROM tagged WHERE reason IS NULL")
def clean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` cleaned as a stream that arrives in files; one row a year later ends it."""
    rows = keep(raw(spark, sf_dir))
    year = RULES.time[1] + 365 * 86_400  # a row of the last second itself comes out once the watermark has passed it
    later = F.timestamp_seconds(F.lit(year + 28_800))
    end = rows.limit(1).select(F.lit("end").alias("traj_id"), F.lit(-1).cast("long").alias("ordinal"), F.lit(39.1).alias("lat"), F.lit(116.0).alias("lon"), F.date_format(later, "yyyy-MM-dd").alias("date"), F.date_format(later, "HH:mm:ss").alias("time"))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows.repartitionByRange(4, "date", "time").write.parquet(f"{at}/in")
    for part, rules, late in ((None, RULES, "40 days"), (end, replace(RULES, time=(RULES.time[0], year + 1)), "0 seconds")):
        if part is not None:  # all that is new to the second run
            part.write.mode("append").parquet(f"{at}/in")
        arriving = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        stream.clean_stream(arriving, rules, late=late).writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("traj_id", "ordinal", F.round("dist_m", 3).alias("dist_m"), "segment_id")


register("clean_counters", f"WITH {SQL_CLEAN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows, count(DISTINCT traj_id) AS n_trajectories FROM tagged GROUP BY 1")(lambda spark, sf: clean.counters(clean.tag(raw(spark, sf), RULES)))
register("traj_ordinal", f"WITH {PTS} SELECT traj_id, ordinal, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY ordinal) - 1 AS INTEGER) AS segment_id FROM pts")(lambda spark, sf: clean.with_ordinal(pts_events(spark, sf)).select("traj_id", "ordinal", "segment_id"))


# ---- analytics ---------------------------------------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.load_vector(distribution(spark, sf_dir, "baseline"), 64)


register("placement_zero_filled", f"{SQL_LOAD} SELECT * FROM ld")(load)
register("load_rank", f"{SQL_LOAD} SELECT *, row_number() OVER (ORDER BY pnode_idx) - 1 AS rank_axis FROM ld")(lambda spark, sf: analytics.load_rank(load(spark, sf)))
register("load_downsample", f"{SQL_LOAD} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pnode_idx) - 1 AS rank_axis FROM ld) WHERE rank_axis % 4 = 0")(lambda spark, sf: analytics.downsample(analytics.load_rank(load(spark, sf)), 20))
register("load_ecdf", f"{SQL_LOAD} SELECT *, row_number() OVER (ORDER BY total_count, pnode_idx) / count(*) OVER () AS ecdf FROM ld")(lambda spark, sf: analytics.load_ecdf(load(spark, sf)))
register("zero_share", f"{SQL_LOAD} SELECT 100.0 * count(*) FILTER (total_count = 0) / count(*) AS zero_pct, min(total_count) FILTER (total_count > 0) AS min_positive FROM ld")(lambda spark, sf: analytics.zero_share(load(spark, sf)))
register("load_balance", f"{SQL_LOAD} SELECT round(max(total_count) / avg(total_count), 9) AS max_over_mean, round(stddev_pop(total_count) / avg(total_count), 9) AS variation FROM ld")(lambda spark, sf: analytics.balance(load(spark, sf)).select(F.round("max_over_mean", 9).alias("max_over_mean"), F.round("variation", 9).alias("variation")))
register("key_histogram", f"WITH {sql_keyed()} SELECT run_length, count(*) AS n_keys FROM (SELECT count(*) AS run_length FROM keyed GROUP BY key) GROUP BY 1")(lambda spark, sf: analytics.key_histogram(keyed(spark, sf)))
register("ingest_bounds", f"WITH {PTS} SELECT count(*) AS n, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(t) AS t_min, max(t) AS t_max FROM pts")(lambda spark, sf: analytics.ingest_bounds(pts_events(spark, sf)))
register("sampled_keys", f"WITH {sql_keyed()} SELECT ordinal, key FROM keyed WHERE ordinal % 500 = 0")(lambda spark, sf: analytics.sampled_keys(keyed(spark, sf), 500))


register("observed_nodes", f"""WITH {sql_keyed()} SELECT count(DISTINCT {sql_node('key', 64)}) AS n_nodes FROM keyed""")(lambda spark, sf: analytics.observed_nodes(distribution(spark, sf, "baseline").filter("total_count > 0")))
register("point_sample", f"WITH {PTS} SELECT ordinal, lat, lon, t FROM pts ORDER BY md5(CAST(ordinal AS VARCHAR)), ordinal LIMIT 200")(lambda spark, sf: analytics.point_sample(pts_events(spark, sf), 200).select("ordinal", "lat", "lon", "t"))
register("clean_account", f"""WITH {SQL_CLEAN}, e AS (SELECT traj_id, count(*) AS n, bool_or(reason IS NULL) AS k, bool_or(reason IS NULL OR reason IN ('speed', 'too_close', 'too_short')) AS late FROM tagged GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS files_total, (SELECT count(*) FROM e WHERE late) AS traj_total, (SELECT count(*) FROM e WHERE late AND NOT k) AS traj_too_short, count(*) AS rows_total, {', '.join(f"count(*) FILTER (reason = '{r}') AS {n}" for r, n in cleaning.COUNTERS.items())} FROM tagged""")(lambda spark, sf: cleaning.account(clean.tag(raw(spark, sf), RULES)))


def loads_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, pnode_idx, total_count`` of two placements."""
    of = lambda mode, run: placement.roll_up(distribution(spark, sf_dir, mode)).select(F.lit(run).alias("run"), "pnode_idx", "total_count")
    return of("baseline", "op64").unionByName(of("vnode", "p16v8"))


SQL_LOADS = f"""WITH {sql_distribution(64, 1)}, vring AS ({sql_ring(16, 8).removeprefix("ring AS (").removesuffix(")")}), vheld AS (SELECT {sql_node('key', 128)} AS v, count(*) AS c FROM keyed GROUP BY 1),
loads AS (SELECT 'op64' AS run, pnode_idx, total_count FROM dist UNION ALL SELECT 'p16v8', pnode_idx, CAST(sum(coalesce(c, 0)) AS BIGINT) FROM vring LEFT JOIN vheld ON v = vnode_idx GROUP BY pnode_idx)"""
register("shown_loads", f"""{SQL_LOADS} SELECT *, CASE WHEN total_count > 0 THEN CAST(total_count AS DOUBLE) ELSE greatest((SELECT coalesce(min(total_count) FILTER (total_count > 0), 1) FROM loads) * {D(0.08)}, {D(1e-12)}) END AS shown FROM loads""")(lambda spark, sf: analytics.shown_loads(loads_of_runs(spark, sf)))
register("observed_groups", f"""{SQL_LOADS}, seen AS (SELECT * FROM loads WHERE total_count > 0)
SELECT (SELECT count(DISTINCT pnode_idx) FROM seen s WHERE s.run = seen.run) AS n_nodes, run, pnode_idx, total_count, row_number() OVER (PARTITION BY run ORDER BY pnode_idx) - 1 AS rank_axis FROM seen""")(lambda spark, sf: analytics.observed_groups(loads_of_runs(spark, sf).filter("total_count > 0")))


@register("run_grid", f"WITH {SQL_REPORT} SELECT name AS query, CAST(sum(returned_count) AS BIGINT) AS op64, NULL::BIGINT AS snode64, NULL::BIGINT AS p64v10 FROM report GROUP BY name")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by window and run, with runs of the grid that were not made."""
    runs = window_query.query_summary(report(spark, sf_dir)).select(F.lit("op64").alias("run"), F.col("name").alias("query"), "total_hits")
    return analytics.run_matrix(runs, "total_hits", ["op64", "snode64", "p64v10"])


register("metric_scale", f"WITH {SQL_REPORT}, s AS (SELECT count(*) AS pnodes, sum(route_hops) AS hops FROM report GROUP BY name) SELECT CAST(max(pnodes) AS DOUBLE) AS max_metric, CAST(max(hops) AS DOUBLE) AS max_against, CAST(max(pnodes) AS DOUBLE) / CAST(max(hops) AS DOUBLE) AS ratio FROM s")(lambda spark, sf: analytics.metric_scale(window_query.query_summary(report(spark, sf))))


@register("scheme_matrix", """SELECT e.query, count(*) FILTER (run = 'op8') AS op8, count(*) FILTER (run = 'snode8') AS snode8, count(*) FILTER (run = 'p8v10') AS p8v10, NULL::BIGINT AS p16v10
FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS query, ['op8', 'snode8', 'p8v10'][user_id % 5 % 3 + 1] AS run FROM events) e GROUP BY e.query""")
def scheme_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    query = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("user_id") % 3 + 1).cast("int"))
    run = F.element_at(F.array(*map(F.lit, ("op8", "snode8", "p8v10"))), (F.col("user_id") % 5 % 3 + 1).cast("int"))
    metrics = e.select(query.alias("query"), run.alias("run")).groupBy("query", "run").agg(F.count(F.lit(1)).alias("hits"))
    names = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    return analytics.scheme_matrix(metrics, names("run", "op8", "snode8", "p8v10", "p16v10"), names("query", "high", "medium", "low"), "hits")
