"""Connected components of a graph of 64-bit nodes by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import keep


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: for each node of an edge the smallest node of its component.

    Every step links nodes to the smallest node they know, found by a partial aggregate and joined back, so
    a node with very many neighbours is combined before the shuffle, and as the other side is written first, the join
    reads two plain shuffles and Spark splits the partition of such a node;
    no neighbourhood is gathered in a task or on the driver.
    Joins are merge joins by hint: estimates from compressed files must not turn a growing side into a broadcast. The number of steps grows with the logarithm
    of the size of the components. Each step is written to the shared folder. Null ends and loops are
    dropped; repeated and reversed edges count once; no edges give no rows."""
    now = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = _size(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
        large = keep(both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        low = keep(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low.hint("merge"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        now = keep(small, "stars")
        before, seen = seen, _size(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
