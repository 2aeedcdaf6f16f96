"""Connected components of a graph in a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node seen from it.

    Large stars move the larger neighbours, small stars the smaller ones. The minimum is
    aggregated before the shuffle and joined back, so a hub's neighbours are never gathered.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = sides.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, component)``, the component named by its least node.

    Nodes without an edge to another node are not returned; null ends and loops are
    ignored, repeated edges count once, an empty table gives an empty table. A path of n
    edges takes about log n rounds; each round's edges are written to the shared folder.
    """
    edges = edges.where("u <> v").select(
        F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")
    )
    current, before = written(edges), None
    for _ in range(max_rounds):
        current = written(_star(_star(current, large=True), large=False))
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component")).distinct()
