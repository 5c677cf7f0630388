"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespace.llm.common import keep, ready

#: Candidates of one block, queries of one group: what a task holds at once.
BLOCK, QUERIES = 8192, 8192
#: By how much a bound computed in doubles may be too low, as a share of it.
SLACK = 1e-9


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, x as double."""
    return np.floor(scale * vectors.astype(np.float64))


def products(q: np.ndarray, x: np.ndarray, most: float | None = None) -> np.ndarray:
    """Exact inner products of whole-numbered vectors: in doubles where they cannot round, else in Python's integers. ``most``: the greatest absolute component of ``x``, if known."""
    if not q.size or not x.size or np.abs(q).max() * (np.abs(x).max() if most is None else most) * x.shape[1] < 2**53:
        return q @ x.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], object)


class Lists:
    """A block of candidates, ordered by id, with one list per dimension sorted from least to greatest component.

    ``asked, stopped, scored`` count the queries, those that the bound ended before all candidates were met, and the
    candidates scored for all of them.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        rank = np.argsort(self.x.T, axis=1, kind="stable")  # a line for each dimension
        self.sorted = np.take_along_axis(self.x.T, rank, axis=1)
        self.rank = rank
        self.most = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.asked = self.stopped = self.scored = 0

    def search(self, query_id: int, v: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the candidates of other ids that can be among the ``k`` best of query ``v``, of which
        ``k`` are known to score ``floor`` or more. All that are returned have their exact score.

        All lists are read in step, from their top where the query's component is positive and from their bottom
        where it is negative, to twice the depth each time. Candidates met are scored at once; a candidate not yet
        met scores no more than the query with the last components read, so the query ends when that bound is below
        its k-th score or the floor (not at it: an equal score may have a lesser id), at the latest when all are met. The last hundredth of a
        block is met in one step.
        """
        n = len(self.x)
        self.asked += 1
        up, down = np.flatnonzero(v > 0), np.flatnonzero(v < 0)
        met = np.zeros(n, bool)
        at, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        kth, done, depth = floor, 0, min(max(4, n // 128), n)
        while done < n:
            here = np.zeros(n, bool)
            if depth == n:
                here[:] = True
            else:
                here[self.rank[up, n - depth : n - done].ravel()] = True
                here[self.rank[down, done:depth].ravel()] = True
            new = np.flatnonzero(here & ~met & (self.ids != query_id))
            met |= here
            if len(new):
                at.append(new)
                # where much of the block is met at once, one product over its lines is cheaper than picking them out
                scores.append(products(v[None], self.x, self.most)[0][new] if 4 * len(new) > n else products(v[None], self.x[new], self.most)[0])
            done = depth
            known = np.concatenate(scores)
            if len(known) >= k:
                kth = max(kth, np.partition(known, len(known) - k)[len(known) - k])
            bound = v[up] @ self.sorted[up, n - depth] + v[down] @ self.sorted[down, depth - 1]
            if kth > bound + abs(bound) * SLACK:
                self.stopped += not met.all()
                break
            unmet = n - np.count_nonzero(met)
            if not unmet:
                break
            depth = min(n, 2 * depth) if 100 * unmet > n else n
        at, known = np.concatenate(at), np.concatenate(scores)
        self.scored += len(at)
        if len(at) > k:
            some = known >= np.partition(known, len(known) - k)[len(known) - k]
            at, known = at[some], known[some]
        best = np.lexsort((self.ids[at], -known))[:k]
        return at[best], known[best]


def _searched(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """``query_id, vec_id, score, mark, floor``: the threshold algorithm for ``queries(id, v, mark, floor)`` over a block of
    ``candidates(id, v)``, by lengths of vectors; ``floor`` is now the query's k-th score, if it has as many."""
    ids, found, scores, marks, floors = [], [], [], [], []
    own = candidates.groupby(candidates.v.map(len))
    blocks = {n: Lists(c.id.to_numpy(), whole(np.stack(c.v.to_numpy()), scale).reshape(len(c), -1)) for n, c in own}
    for query, v, mark, floor in zip(queries.id, queries.v, queries["mark"], queries.floor, strict=True):
        if (lists := blocks.get(len(v))) is None:
            continue
        at, s = lists.search(query, whole(np.asarray(v), scale), k, floor)
        held = [max(-(2**63), min(2**63 - 1, int(x))) for x in s]
        ids += [query] * len(at)
        marks += [mark] * len(at)
        floors += [float(s[-1]) if len(s) == k else -np.inf] * len(at)
        found.append(lists.ids[at])
        scores += held
    long = lambda x: np.array(x, np.int64)
    return pd.DataFrame({"query_id": long(ids), "vec_id": np.concatenate([long([]), *found]), "score": long(scores), "mark": long(marks), "floor": np.array(floors, np.float64)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` selects, its ``k`` highest integer inner
    products with rows of other ids (all, if fewer), ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and null ids,
    take no part; a pair of vectors of different lengths has no score. Repeated rows count once; different vectors
    of one id are separate rows, and an id may then answer a query more than once. Scores beyond a long are held at
    its ends. No rows: no rows.

    Candidates are dealt into blocks by hash. Each query first searches the block it lies in, where nothing has to be
    copied for it; its k-th score there is its floor. It then goes on, with its floor, to those blocks only whose
    greatest and least components leave room for a score that reaches it, and only blocks that some query goes to
    are copied, once for each group of ``QUERIES`` queries. Each search runs the threshold algorithm over the block's
    sorted lists (:class:`Lists`); the blocks' best are merged.
    """
    spark = ready(vectors.sparkSession)
    v = F.col(embedding).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.filter(sound & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = keep(rows.dropDuplicates(["id", "v"]))
    n = rows.count()
    blocks = -(-n // BLOCK) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("mark", F.xxhash64("v"))  # tells queries of one id apart; where it should not, the lower floor holds
    schema = "query_id long, vec_id long, score long, mark long, floor double"

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        return _searched(pdf, pdf[pdf.q].assign(floor=-np.inf), k, scale)

    home = keep(rows.groupBy("block").applyInPandas(at_home, schema))
    floor = home.groupBy(F.col("query_id").alias("id"), "mark").agg(F.min("floor").alias("floor"))
    ask = rows.filter("q").join(floor, ["id", "mark"], "left").select("id", "v", "mark", F.col("block").alias("home"), F.coalesce("floor", F.lit(-float("inf"))).alias("floor"))

    # a block's greatest and least component in each dimension, by length of vectors
    parts = rows.select("block", F.size("v").alias("len"), F.posexplode(F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double"))).alias("i", "x"))
    ends = parts.groupBy("block", "len", "i").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    ends = ends.groupBy("block", "len").agg(F.array_sort(F.collect_list(F.struct("i", "hi", "lo"))).alias("ends"))  # as long as a vector
    reach = F.aggregate(
        F.zip_with(F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")), "ends", lambda x, e: F.greatest(x * e["hi"], x * e["lo"])), F.lit(0.0), lambda a, x: a + x
    )
    asked = ask.select("*", F.size("v").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).filter("block <> home")
    open_ = asked.join(ends, ["block", "len"]).filter(reach + F.abs(reach) * SLACK >= F.col("floor"))
    groups = F.greatest(F.lit(1), F.ceil(F.lit(n) / QUERIES)).cast("long")  # at most; most stay without queries
    todo = keep(open_.select("block", F.pmod(F.xxhash64("id", "v", F.lit(2)), groups).cast("int").alias("group"), "id", "v", "mark", "floor"))
    visits = todo.select(F.col("block").alias("at"), F.col("group").alias("for")).distinct()
    copies = rows.join(visits, F.col("block") == F.col("at")).select(F.col("at").alias("b"), F.col("for").alias("g"), "id", "v")

    def elsewhere(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _searched(candidates, queries, k, scale)

    away = copies.groupBy("b", "g").cogroup(todo.groupBy("block", "group")).applyInPandas(elsewhere, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.union(away).select("query_id", "vec_id", "score").withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the registered query, over sound vectors of unique ids.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
