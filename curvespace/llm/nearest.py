"""Nearest vectors by cosine: a block matrix join over int8 tiles, with error bounds and exact scores for what they leave."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from curvespace.llm.common import keep, ready

#: Vectors of one tile, and tiles of each side that meet in one task (two panels of 32,768 vectors at most).
TILE, PANEL = 1024, 32
#: Room for rounding in scores, which are at most about 1.
SLACK = 1e-9
#: Up to so many dimensions products of int8 vectors are exact in single precision (127 * 127 * 1040 < 2**24).
SINGLE = 1040

TILE_SCHEMA = "len int, tile long, ids binary, ints binary, scale binary, rest binary, norm binary, own binary"


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the columns of ``x`` (dimensions by vectors), summed dimension by dimension."""
    out = np.zeros(x.shape[1])
    for line in x:
        out += line * line
    return np.sqrt(out)


class Tile:
    """Vectors of one length: ids, unit vectors as int8 with a scale each, what the rounding left (its length), and the originals."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, scale: np.ndarray, rest: np.ndarray, norm: np.ndarray, own: np.ndarray):
        self.ids, self.ints, self.scale, self.rest, self.norm, self.own = ids, ints, scale, rest, norm, own

    @classmethod
    def of(cls, ids: np.ndarray, own: np.ndarray) -> Tile:
        """``own``: a line for each vector."""
        x = own.astype(np.float64).T
        norm = norms(x)
        unit = x / norm
        scale = np.abs(unit).max(axis=0) / 127
        ints = np.rint(unit / scale).astype(np.int8)
        return cls(ids, ints.T.copy(), scale, np.sqrt(((unit - ints * scale) ** 2).sum(axis=0)), norm, own)

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.ints, self.scale, self.rest, self.norm, self.own)]

    @classmethod
    def back(cls, dims: int, kind: str, ids: bytes, ints: bytes, scale: bytes, rest: bytes, norm: bytes, own: bytes) -> Tile:
        real = lambda b: np.frombuffer(b, "<f8")
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(ints, "i1").reshape(-1, dims), real(scale), real(rest), real(norm), np.frombuffer(own, kind).reshape(-1, dims))


class Heaps:
    """The ``k`` best of each query of a tile so far, and the score that a further one has to reach."""

    def __init__(self, queries: Tile, k: int):
        self.q, self.k = queries, k
        self.dims = queries.ints.shape[1]
        self.kind = np.float32 if self.dims <= SINGLE else np.float64
        self.left, self.x = queries.ints.astype(self.kind), queries.own.astype(np.float64).T.copy()
        self.held: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)
        self.pairs = self.rescored = 0

    def meet(self, c: Tile) -> None:
        """Take in a tile of candidates. The product of the int8 vectors bounds every cosine from both sides; a pair goes on
        only if its upper bound reaches the query's floor, which is its k-th best score, or while it has fewer, the k-th best
        lower bound. What goes on is scored on the original vectors."""
        if not len(c.ids):
            return
        near = (self.left @ c.ints.astype(self.kind).T).astype(np.float64) * self.q.scale[:, None] * c.scale
        room = self.q.rest[:, None] + (1 + self.q.rest)[:, None] * c.rest + SLACK
        same = np.flatnonzero(np.isin(c.ids, self.q.ids))
        near[:, same] = np.where(self.q.ids[:, None] == c.ids[same], -np.inf, near[:, same])  # no row answers itself
        floor = self.floor.copy()
        if len(c.ids) >= self.k and (short := np.flatnonzero(np.isneginf(floor))).size:
            floor[short] = np.partition(near[short] - room[short], len(c.ids) - self.k, axis=1)[:, len(c.ids) - self.k]
        q, at = np.nonzero((near + room >= floor[:, None]) & ~np.isneginf(near))
        self.pairs += near.size
        self.rescored += len(q)
        if not len(q):
            return
        x, dot = c.own.astype(np.float64).T, np.zeros(len(q))
        for mine, theirs in zip(self.x, x, strict=True):
            dot += mine[q] * theirs[at]
        score = dot / (self.q.norm[q] * c.norm[at])
        ids = c.ids[at]
        ends = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        for lo, hi in zip(ends, ends[1:], strict=False):
            best = np.lexsort((ids[lo:hi], -score[lo:hi]))[: self.k] + lo
            heap = self.held[q[lo]]
            for s, i in zip(score[best].tolist(), ids[best].tolist(), strict=True):
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
            if len(heap) == self.k:
                self.floor[q[lo]] = heap[0][0]

    def rows(self) -> list[tuple[int, int, float]]:
        return [(query, -i, s) for query, heap in zip(self.q.ids.tolist(), self.held, strict=True) for s, i in heap]


def tiles(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """``rows(id, v)`` dealt into tiles of about ``TILE`` vectors of one length, by hash of id and vector."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dims, number = key[0].as_py(), key[1].as_py()
        own = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
        made = Tile.of(table.column("id").to_numpy().astype("<i8"), own)
        return pa.table({"len": pa.array([dims], pa.int32()), "tile": pa.array([number], pa.int64()), **{c: pa.array([b], pa.binary()) for c, b in zip(("ids", "ints", "scale", "rest", "norm", "own"), made.row(), strict=True)}})

    number = F.pmod(F.xxhash64("id", "v"), F.lit(-(-n // TILE) or 1))
    return rows.select(F.size("v").alias("len"), number.alias("tile"), "id", "v").groupBy("len", "tile").applyInArrow(build, TILE_SCHEMA)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` selects, the ``k`` rows of other ids with the largest
    cosine (all, if fewer), ties to the smaller id. The search is exact: recall is 1.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do those whose squared length is
    not a positive finite double, and null ids; vectors of different lengths have no cosine. Repeated rows count once;
    different vectors of one id are separate rows, whose answers are ranked together. Other columns are ignored. No rows: no
    rows.

    Of equal vectors only those of the ``k`` + 1 least ids can answer; the others are left out before anything is copied, so a vector
    that a third of the rows share costs no more than any other. The rest is dealt into tiles of ``TILE`` vectors. A task
    meets a panel of query tiles with a panel of candidate tiles (:class:`Heaps`), and returns ``k`` rows a query at most;
    these are merged by query. Each panel is copied once for each panel of the other side.
    """
    spark = ready(vectors.sparkSession)
    single = vectors.schema[embedding].dataType == ArrayType(FloatType(), vectors.schema[embedding].dataType.containsNull)
    kind, v = ("<f4", F.col(embedding)) if single else ("<f8", F.col(embedding).cast("array<double>"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.filter(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    rows = keep(rows.filter((square > 0) & (square < float("inf"))).groupBy("id", "v").agg(F.max("q").alias("q")))
    alike = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = keep(rows.select("id", "v").withColumn("n", alike).filter(F.col("n") <= k + 1).drop("n"))
    n, nq = candidates.count(), rows.filter("q").count()
    panels = lambda m: -(-(-(-m // TILE)) // PANEL) or 1

    def panel(side: DataFrame, m: int, mine: str, other: str) -> DataFrame:
        own = tiles(side, m, kind).withColumn(mine, F.floor(F.col("tile") / PANEL).cast("int"))
        return own.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(panels(nq if mine == "c" else n) - 1))))

    def met(queries: pa.Table, others: pa.Table) -> pa.Table:
        cols = ["len", "ids", "ints", "scale", "rest", "norm", "own"]
        back = lambda r: Tile.back(r["len"], kind, *[r[c] for c in cols[1:]])
        against = [back(r) for r in others.select(cols).to_pylist()]
        out: list[tuple[int, int, float]] = []
        for r in queries.select(cols).to_pylist():
            heaps = Heaps(back(r), k)
            for c in against:
                heaps.meet(c)
            out += heaps.rows()
        ids, near, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(scores, pa.float64())})

    qs, cs = panel(rows.filter("q").select("id", "v"), nq, "q", "c"), panel(candidates, n, "c", "q")
    found = qs.groupBy("len", "q", "c").cogroup(cs.groupBy("len", "q", "c")).applyInArrow(met, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the registered query, over sound vectors of unique ids.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(e, lambda x: x * x)), lambda a, b: a + b)) AS n FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) / (q.n * c.n) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
