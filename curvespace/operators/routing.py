"""Routing on the ring: finger tables and hops from the entry node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespace.operators.placement import spacing
from curvespace.sources.shared import keep


def hops(key: Column, n: int, ring_bits: int) -> Column:
    """Hops from node 0 to the node of ``key`` on a uniform ring of ``n`` nodes.

    Greedy fingers cover the distance to the node before the key with steps of ceil(2**k / spacing) nodes, the
    largest first; one more hop reaches the node itself.
    """
    s = spacing(n, ring_bits)
    d = F.when((key == 0) | (key > (n - 1) * s), F.lit(n - 1)).otherwise(F.ceil(key / F.lit(s)) - 1).cast("long")
    if n & (n - 1) == 0:
        return (F.bit_count(d) + 1).cast("long")
    out = F.lit(1).cast("long")
    for step in sorted({-(-(2**k) // s) for k in range(ring_bits)}, reverse=True):
        out, d = out + F.floor(d / F.lit(step)), d % F.lit(step)
    return out.cast("long")


def fingers(ring: DataFrame, ring_bits: int) -> DataFrame:
    """``vnode_idx, k, target, finger_idx``: the first node at or after ``node_id + 2**k``, else node 0. Of nodes with
    equal ids the first counts."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(min(ring_bits, 63) - 1)))
    wanted = ring.select("vnode_idx", "node_id", ks.alias("k")).withColumn("target", F.col("node_id") + F.expr("shiftleft(1L, k)"))
    return _at_or_after(wanted, ring, "target", ["vnode_idx", "node_id", "k", "target"]).withColumnRenamed("idx", "finger_idx").drop("node_id")


def _at_or_after(rows: DataFrame, ring: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """``carry`` and ``idx``, the first node at or after ``key``: nodes and keys in one order, each key takes the next
    node below it in the list. The lists are of the ring's size."""
    nodes = ring.groupBy("node_id").agg(F.min("vnode_idx").alias("n_")).select(F.col("node_id").alias("at_"), "n_", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carry])
    keys = rows.select(F.col(key).alias("at_"), F.lit(None).cast("long").alias("n_"), *carry)
    after = W.orderBy(F.col("at_"), F.col("n_").isNotNull()).rowsBetween(0, W.unboundedFollowing)
    met = keys.unionByName(nodes).withColumn("idx", F.first("n_", ignorenulls=True).over(after)).filter("n_ is null")
    return met.select(*carry, F.coalesce("idx", F.lit(0)).cast("long").alias("idx"))


def hops_on(ring: DataFrame, keys: DataFrame, ring_bits: int) -> DataFrame:
    """``key, node_idx, hops`` of ``keys(key)`` from node 0 of any ring, by following fingers with joins; a step per
    round for all keys at once."""
    ids = ring.select("vnode_idx", "node_id")
    start = ids.filter("vnode_idx = 0").agg(F.coalesce(F.min("node_id"), F.lit(0))).first()[0]
    table = fingers(ring, ring_bits).join(ids.select(F.col("vnode_idx").alias("finger_idx"), F.col("node_id").alias("finger_id")), "finger_idx").join(ids, "vnode_idx")
    table = table.filter(F.col("finger_id") > F.col("node_id")).groupBy("vnode_idx").agg(F.array_sort(F.collect_set(F.struct("finger_id", "finger_idx"))).alias("f"))
    table = keep(table)
    end = _at_or_after(keys.distinct(), ring, "key", ["key"]).withColumnRenamed("idx", "node_idx")
    # the last node before the key is where the greedy walk ends; the hop after it reaches the key's node
    walk = end.select("key", "node_idx", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("hops"))
    while True:  # every step moves on along the ring, so the walks end
        reach = F.when(F.col("key") <= start, F.lit(2**62)).otherwise(F.col("key"))  # node 0's own keys lie a whole turn ahead
        best = F.element_at(F.filter("f", lambda x: x["finger_id"] < reach), -1)
        stepped = walk.join(table, F.col("at") == F.col("vnode_idx"), "left").withColumn("next", F.when(F.size(F.filter("f", lambda x: x["finger_id"] < reach)) > 0, best["finger_idx"]))
        moved = F.col("next").isNotNull()
        walk = stepped.select("key", "node_idx", F.coalesce("next", "at").alias("at"), (F.col("hops") + moved.cast("long")).alias("hops"), moved.alias("moved"))
        walk = keep(walk)
        if not walk.filter("moved").limit(1).count():
            break
        walk = walk.drop("moved")
    return walk.select("key", "node_idx", "hops")
