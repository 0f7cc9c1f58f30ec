"""Connected components as DataFrame joins: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node on an edge; component is its smallest reachable node.

    ``edges`` has long columns u and v; repeated and reversed edges and loops are
    allowed, rows with a null are ignored, an empty table gives an empty result.
    Each round is two equi-joins with partially aggregated minima, so a node with
    very many neighbours is spread by Spark's skew join; lineage is cut each round.
    Stops when a round changes nothing; raises if that takes over ``max_rounds``.
    """
    e = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e).distinct()).distinct())
        # A star forest is a fixed point: each node has one parent and no parent has a parent.
        state = e.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        now = (state["n"], state["h"])
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
