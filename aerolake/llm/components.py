"""Connected components of a large graph by alternating star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import materialize, release


def smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Of each node u, the smallest of itself and its neighbours v; written out, so that joins see its real size."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v), root being the smallest node that it reaches.

    A large-star step links every larger neighbour of a node to the node's smallest neighbour, a small-star step
    does so with the smaller ones. They end when nothing changes, after a logarithmic number of rounds; edges never grow
    in number. Both need only minima by key and joins, never a node's list of neighbours.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        around = materialize(both_ways(edges))
        lowest = smallest_neighbour(around)
        large = around.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        spread = materialize(large.distinct())
        release(edges, around, lowest)
        low = smallest_neighbour(spread)
        small = spread.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        release(spread, low)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
