"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvespace.sources.shared import forget, keep, ready, shared_dir

__all__ = ["components", "forget", "free_name", "free_names", "join_spread", "keep", "ranked", "ready", "shared_dir", "tagged"]


def free_name(df: DataFrame, base: str, *more: str) -> str:
    """A column name that neither ``df`` nor ``more`` has (names compare without case)."""
    taken = {c.lower() for c in (*df.columns, *more)}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """Several such names, all different."""
    out: list[str] = []
    for base in bases:
        out.append(free_name(df, base, *out))
    return out


def tagged(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``name``, fixed by writing it down: partition number times 2**33, plus place in it."""
    return keep(df.withColumn(name, F.monotonically_increasing_id()))


def ranked(df: DataFrame, keys: Sequence[str], rid: str, name: str, order: Sequence[Column] = (), block_bits: int = 16) -> DataFrame:
    """``df`` with ``name``: place from 0 among the rows of equal ``keys``, by ``order`` and then ``rid``.

    ``rid`` is a column of :func:`tagged`. Rows are numbered inside blocks of bounded size and the blocks' counts
    are summed, so no task ever holds all rows of a key. Without ``order`` the blocks are pieces of the input
    partitions, of ``2**block_bits`` rows at most; with it, they are ranges of (keys, order, rid).
    """
    blk, at, many, base, *own = free_names(df, "blk", "at_blk", "many", "base", *[f"own_{k}" for k in keys])
    if order:
        n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        df = keep(df.repartitionByRange(n, *[F.col(k) for k in keys], *order, F.col(rid)).withColumn(blk, F.spark_partition_id().cast("long")))
    else:
        df = df.withColumn(blk, F.shiftright(F.col(rid), block_bits))
    within = Window.partitionBy(*keys, blk).orderBy(*order, rid)
    counts = df.groupBy(*keys, blk).agg(F.count(F.lit(1)).alias(many))
    before = F.sum(many).over(Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(blk).alias(at), F.coalesce(before, F.lit(0)).alias(base))
    on = F.col(blk) == F.col(at)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    rows = df.withColumn(name, F.row_number().over(within) - 1)
    return rows.join(starts, on).withColumn(name, F.col(name).cast("long") + F.col(base)).select(*[c for c in df.columns if c != blk], name)


def join_spread(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keys`` (unique ``key``, and ``n``: its rows) by equality; no task gets a large key whole.

    Keys of more rows than one in 10,000 of all (1,000 at least) number 10,000 at most and are broadcast; the others
    are dealt by key. Both tables are read more than once, so they should be made by :func:`keep`.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") > max(1000, total // 10_000)
    hot, rest = F.broadcast(keys.filter(many).drop("n")), keys.filter(~many).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``, both long: ``(node, root)`` with root the least node reachable.

    In each round every node hooks on its least neighbour, if that is less than itself; the trees that this makes are
    flattened by pointer jumping and contracted to their roots, and the links left between different roots go on to the
    next round. Of two linked nodes one always hooks, so a round at least halves the nodes of each component: rounds and
    jumps grow with the logarithm of the longest chain, whatever its order. There is no limit on either: the loops
    end where nothing moves and no link is left. Each step is written to the shared folder; single rows return to the driver.
    """
    labels = None
    least, most = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    links = keep(edges.select(least, most).distinct())
    while True:
        both = links.union(links.select("v", "u"))
        tree = keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
        while True:
            up = tree.select(F.col("node").alias("at"), F.col("root").alias("up"))
            jumped = keep(tree.join(up, tree.root == up.at).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            forget(tree)
            tree = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        up = tree.select(F.col("node").alias("at"), F.col("root").alias("up"))
        if labels is None:
            labels = tree
        else:
            new = keep(labels.join(up, labels.root == up.at, "left").select("node", F.coalesce("up", "root").alias("root")))
            forget(labels)
            labels = new
        ends = links.join(up, links.u == up.at).select(F.col("up").alias("a"), "v").join(up, F.col("v") == up.at).select("a", F.col("up").alias("b")).filter("a <> b")
        left = keep(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        forget(links)
        links = left
        if tree is not labels:
            forget(tree)
        if left.isEmpty():
            forget(left)
            return labels
