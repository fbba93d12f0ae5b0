"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 60


def star_components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for the end points of ``links`` (a, b: comparable).

    Large stars hang every larger neighbour on a node's smallest neighbour, small stars
    every smaller one; a hub's links are reduced to a minimum before they are shuffled, and
    the minima are written, so that adaptive execution can split a hub in the joins.
    Ends when a round changes nothing, after a logarithmic number of rounds.
    """
    ordered = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(links.where("a <> b").select(ordered[0].alias("a"), ordered[1].alias("b")).distinct())
    mark = None
    for _ in range(ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least)
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        smallest = materialize(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(smallest, "b").select(F.col("m"), "a", "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = materialize(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # Every edge now joins a component's smallest node to a member.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
