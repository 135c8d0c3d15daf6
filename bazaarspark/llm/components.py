"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a partial minimum per node
and a join, so a hub with a third of all edges is pre-aggregated and its join is split by the adaptive planner. Joins are hinted:
sizes of files of edges, which compress well, would let Spark broadcast millions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above ``u`` is linked to the smallest of ``u`` and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(least.hint("merge"), "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` and its neighbours below it are linked to the smallest of these. Edges come as (small u, large v)."""
    down = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    linked = down.join(least.hint("merge"), "x").select(F.col("m").alias("u"), F.col("y").alias("v"))
    return linked.unionByName(least.select(F.col("m").alias("u"), F.col("x").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge, as (node, component): the component's smallest node.

    Self loops, repeated edges, either direction and edges with a null end are allowed; the last are ignored.
    An empty table gives an empty one. Rounds grow with the logarithm of the number of nodes.
    """
    now = scratch.written(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok and u < v").select("u", "v").distinct(), "edges"
    )
    mark = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if not state[0] or tuple(state) == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before, mark = now, tuple(state)
        now = scratch.written(_small_star(_large_star(before)), "edges")
        scratch.drop(before)
