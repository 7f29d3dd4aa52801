"""Connected components by parent hooking and pointer jumping, all in joins and aggregates.

No adjacency list is ever gathered: every step is a map-side combined ``min`` or an equi-join
against a table with one row per node, so that a hub is a skewed join side that adaptive
execution can split.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, component)``, component = smallest node.

    Self-loops and null ends are ignored, repeated edges count once.  Nodes without an edge to
    another node are not returned; an empty input gives an empty output.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p")).where("u is not null and p is not null and u <> p and a is not null and b is not null").distinct()
    now = scratch.put(now, "edges")
    while not _flat(now):
        least = now.groupBy("u").agg(F.min("p").alias("m"))
        hooked = (
            now.join(least, "u")
            .select(F.explode(F.when(F.col("p") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(F.array(F.struct("u", "m"), F.struct(F.col("p").alias("u"), "m")))).alias("e"))
            .select("e.u", F.col("e.m").alias("p"))
            .distinct()
        )
        up = hooked.groupBy("u").agg(F.min("p").alias("g")).withColumnRenamed("u", "p")
        after = scratch.put(hooked.join(up, "p", "left").select("u", F.coalesce("g", "p").alias("p")).distinct(), "edges")
        scratch.drop(now)
        now = after
    roots = now.select(F.col("p").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("p").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _flat(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("p").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or c > 0 and p > 0").isEmpty()
