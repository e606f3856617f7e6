"""Connected components of a distributed edge table, by alternating large and small stars.

Both stars only ever link a node to the least node it has met, so no node gathers more rows than it has
links, and hot nodes are summed before the shuffle.  Each round is written to the shared folder; the rounds end when
one leaves the edges as they were, which three sums over them tell (two of 64-bit hashes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leontia.llm.common import cut


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, cut, and their number and two sums over their hashes, taken as they are written: no job is run to compare tables."""
    sums = Observation()
    one, other = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return cut(edges.observe(sums, F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(20,0)")).alias("one"), F.sum(other.cast("decimal(20,0)")).alias("other"))), sums.get


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the least node of the component."""
    edges, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        up = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(up, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(up.select("u", F.col("m").alias("v"))).distinct()
        edges, now = _written(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
