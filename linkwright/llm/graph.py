"""Connected components by alternating large and small stars, on edges that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import materialize


def _least(sym: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least node among u and its neighbours."""
    # written, so that the join reads both sides from shuffles of their own and the edges of one node can be split
    least = materialize(sym.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")), narrow=True)
    return sym.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for the nodes of ``edges``; the root is the least node of the component. Self-loops are ignored."""
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), narrow=True)
    before = _state(e)
    while before[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(sym).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, narrow=True)
        near = _least(large)  # here v < u, so m is the least neighbour
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = materialize(small, narrow=True)
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
