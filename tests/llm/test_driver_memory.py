"""What goes through the driver."""

from pyspark.sql import functions as F

from curvespace.llm import simhash
from curvespace.llm.common import keep


def test_cells_of_fingerprints_are_not_broadcast(spark):
    """Each fingerprint makes up to 33 rows, and Spark sizes them like one."""
    fps = keep(spark.range(2000).select(F.xxhash64("id").alias("fp")).union(spark.range(3).select(F.col("id").alias("fp"))))
    links = simhash.hamming_links(fps)
    assert sorted(map(tuple, links.collect())) == [(0, 1), (0, 2), (1, 2)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
