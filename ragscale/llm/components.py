"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ragscale.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``node, root`` for every node of ``links`` (two comparable columns), root being the smallest reachable node.

    Each round points every node's larger neighbours, then its smaller ones, at its smallest neighbour, so that links
    become stars in a number of rounds that grows with the logarithm of the longest path. Neighbourhoods are never
    gathered: a round is an aggregation with map-side combine and a join that adaptive execution can split. Links
    with a null end and links of a node to itself are ignored; an empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, "links")
    seen = _state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.select("u", F.col("m").alias("v"))
        edges = materialize(small.unionByName(kept).distinct(), "links")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
