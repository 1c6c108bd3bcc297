"""Connected components by alternating large-star and small-star steps, each a join and a distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or other (small star) neighbours to the least of its neighbourhood.

    The least ones are written out first: the join then shuffles both sides plainly, so AQE may split a node with very many neighbours."""
    least = cut(neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "components-least")
    joined = neighbours.join(by_shuffle(least), "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the least node that it reaches.

    Every round is written to the shared folder. Rounds end when the edges stand still, which
    happens after about the square of the logarithm of the node count at the worst; beyond
    `most_rounds` a RuntimeError is raised, never a wrong result given."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        print_of = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_of == seen or not print_of[0]:
            break
        seen = print_of
        large = _star(_both_ways(now), large=True)
        small = _star(cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components-large"), large=False)
        now = cut(small, "components")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
