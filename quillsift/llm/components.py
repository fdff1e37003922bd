"""Connected components by alternating large-star and small-star rounds, each written to the shared folder.

The least neighbour of every node is a table with a row for each node, written before it is joined. The join then stands
right above the two scans, so that Spark's adaptive skew join splits a node that has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins the larger neighbours of each node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * n)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them; edges point from u to a smaller v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least", n)
    rows = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, component): the least node that can be reached. Nodes without edges are not listed."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    stamp = _stamp(edges)
    while stamp[0]:
        n = stamp[0]  # no star step has more edges than its input has in both directions
        edges = written(_small_star(written(_large_star(edges, n), "edges", 2 * n), 2 * n), "edges", 4 * n)
        last, stamp = stamp, _stamp(edges)
        if stamp == last:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
