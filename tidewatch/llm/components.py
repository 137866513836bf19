"""Connected components of link tables: large-star and small-star steps (Kiveris et al., 2014), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, discard


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) the least neighbour ``m`` of u.

    Each node's minimum is repeated for two slices of its edges: both sides of the join are then shuffled for it, so that Spark may
    divide the edges of a node that has very many of them over several tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("slice", F.explode(F.array(F.lit(0), F.lit(1))))
    return edges.withColumn("slice", F.pmod(F.xxhash64("v"), F.lit(2)).cast("int")).join(least, ["u", "slice"]).drop("slice")


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``a``, ``b``); the root is the least node that can be reached.

    Links that are null on a side or join a node to itself say nothing; repeated links count once; no links give no rows.
    Only a row count and a checksum of each round come to the driver; rounds go on until nothing changes."""
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least_neighbour(both).withColumn("m", F.least("u", "m"))
        large = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _least_neighbour(large)
        small = (down.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        after = cut(small, "edges")
        now = _mark(after)
        discard(edges)
        edges = after
        if now == mark:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        mark = now
