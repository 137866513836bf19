"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpointed, drop_checkpoint


def _with_min(edges: DataFrame) -> DataFrame:
    """Adds ``m``, the least neighbour of ``u``.

    The minimum of a node is repeated for two slices of its edges, so both sides of the join are shuffled for it and Spark may divide the
    edges of a node of very high degree over several tasks.  The plan is the same at every size: there are as many minima as nodes, and
    the files of a round hold long, similar names in few bytes, so Spark would take them for small and send all of them to the driver."""
    m = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("_slice", F.explode(F.array(F.lit(0), F.lit(1))))
    return edges.withColumn("_slice", F.pmod(F.xxhash64("v"), F.lit(2)).cast("int")).join(m.hint("merge"), ["u", "_slice"]).drop("_slice")


def _cut(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Edges written and read back, with their number and a checksum observed during the write."""
    out, seen = checkpointed(edges, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return out, (int(seen["n"] or 0), int(seen["h"] or 0))


def _pairs(rows: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """Every row as one (u, v) per side.  A union would hold the plan of ``rows`` once per side, and the driver would plan and keep a round
    many times over."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in sides])).alias("_p")).select("_p.u", "_p.v")


def _leaves(edges: DataFrame) -> DataFrame:
    """Edges (u, v) whose ``u`` has no other edge.  As v < u, the component of v is that of u, and its least node stays when u goes."""
    one = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    return one.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    Nodes that hang on one smaller node take no part in the rounds, but get its component at the end.  Each round ends in a written
    table, and the table of the round before is deleted; only an edge count and a checksum come to the driver.  Rounds go on until
    nothing changes."""
    a, b = F.col(src), F.col(dst)
    whole, _ = _cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    leaves = checkpointed(_leaves(whole))
    e, mark = _cut(whole.join(leaves.select("u"), "u", "left_anti"))
    drop_checkpoint(whole)
    while mark[0]:
        near = _with_min(_pairs(e, ("u", "v"), ("v", "u"))).withColumn("m", F.least("u", "m"))
        large = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _pairs(_with_min(large), ("v", "m"), ("u", "m")).where(F.col("u") != F.col("v")).distinct()
        after, new = _cut(small)
        drop_checkpoint(e)
        e = after
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    inner = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    hung = leaves.join(inner.withColumnRenamed("node", "v"), "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    alone = leaves.select(F.col("v").alias("node")).distinct().join(inner.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return inner.unionByName(hung).unionByName(alone)
