"""Every registered query of the trajectory operators: against DuckDB, or against a plain version where SQL has none."""

import itertools

import pytest
from pyspark.sql import functions as F

from curvespace import queries
from curvespace.functions import hilbert2, hilbert_xy


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small, check_sql, name):
    check_sql(queries.QUERIES[name](spark, small), queries.ORACLE[name], small)


@pytest.mark.parametrize("bits", [1, 3, 5, 7])
def test_hilbert_curve_visits_every_cell_by_single_steps(spark, bits):
    x, y = hilbert_xy(F.col("id"), bits)
    rows = spark.range(1 << 2 * bits).select("id", x.alias("x"), y.alias("y")).select("*", hilbert2(F.col("x"), F.col("y"), bits).alias("d")).orderBy("id").collect()
    path = [(r.x, r.y) for r in rows]
    assert len(set(path)) == len(path)
    assert all(abs(a - c) + abs(b - e) == 1 for (a, b), (c, e) in itertools.pairwise(path))
    assert all(r.d == r.id for r in rows)
    if bits > 1:  # a square's first digits are its own place
        tops = [hilbert2(F.lit(x).cast("long"), F.lit(y).cast("long"), bits - 1).alias(f"c{x}_{y}") for x in range(2) for y in range(2)]
        first = spark.range(1).select(*tops).first().asDict()
        assert {(r.x >> 1, r.y >> 1): r.d >> 2 for r in rows if max(r.x, r.y) < 4} == {(int(k[1]), int(k[3])): v for k, v in first.items()}


def test_packed_ring_has_the_hops_of_a_routing_walk(spark):
    from curvespace.operators import routing

    bits, ids = 10, [3, 70, 71, 200, 512, 900, 1000]
    after = lambda k: next((i for i, v in enumerate(ids) if v >= k), 0)
    jumps = [[after(v + 2**k) for k in range(bits)] for v in ids]
    between = lambda x, a, b: a < x <= b if a < b else x > a or x <= b

    def walk(key):
        at, n = 0, 1
        while not between(key, ids[at], ids[(at + 1) % len(ids)]):
            at = next((j for j in reversed(jumps[at]) if between(ids[j], ids[at], key - 1)), (at + 1) % len(ids))
            n += 1
        return n

    ring = spark.createDataFrame([(i, i, v) for i, v in enumerate(ids)], "pnode_idx long, vnode_idx long, node_id long")
    keys = [1, 3, 4, 70, 72, 150, 333, 512, 513, 899, 901, 1000, 1010]
    got = routing.hops_on(ring, spark.createDataFrame([(k,) for k in keys], "key long"), bits)
    assert {r.key: r.hops for r in got.collect()} == {k: walk(k) for k in keys}
