"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and aggregates that Spark deals out; its edges are written to the shared folder, so the lineage stays
short and a lost executor costs a part of one round. The driver sees two numbers a round, never an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """edges (n, x) with m, the least of n and all its x. The least values are written first: the join then meets two plain
    exchanges, of which the runtime can split a hot n."""
    least = materialise(edges.groupBy("n").agg(F.min("x").alias("m")), name)
    return edges.join(least, "n").withColumn("m", F.least("n", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the component's least node), for every node of an edge between different nodes."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialise(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("x")).union(now.select(F.col("v"), F.col("u")))
        large = _with_least(both, "large").where(F.col("x") > F.col("n")).select(F.col("x").alias("n"), F.col("m").alias("x")).distinct()
        large = materialise(large, "large-star")
        small = _with_least(large, "small").select(F.explode(F.array(F.struct(F.col("n").alias("u"), F.col("m").alias("v")), F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialise(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
