"""Connected components of an edge table, by alternating large and small stars.

Both stars replace edges by edges to the smallest known node, so a component
ends as a star around its smallest node after a number of rounds that grows
with the logarithm of its size.  A hub's edges are never gathered: minima
are pre-aggregated and joined back, and a skewed join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloria.llm.blocks import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v) with v < u.  One star step, again as such edges."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of pairs (u, v) that is not the smallest of its component."""
    edges = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    sign = _sign(edges)
    for _ in range(most_rounds):
        if not sign[0]:
            break
        edges = stored(_star(_star(edges, True), False))
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
