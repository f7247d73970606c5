"""Connected components of an edge table by alternating large and small stars; every round is a stored table, which takes the place of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove, stored


def _rewired(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (a > b). Each node points its larger (or, small, its smaller) neighbours and itself at its least neighbour.
    The least neighbour is aggregated before the shuffle and joined back, so a node with very many edges is no group in one task."""
    around = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    joined = around.join(least, "a")
    if small:
        pairs = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    else:
        pairs = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b: bigint): the least node reachable."""
    up = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = edges.sparkSession
    now, path = stored(up, "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        large, large_path = stored(_rewired(now, small=False), "edges")
        remove(spark, path)
        now, path = stored(_rewired(large, small=True), "edges")
        remove(spark, large_path)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
