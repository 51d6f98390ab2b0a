"""Connected components of an edge list by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    bad = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1")
    return bad.agg(F.count("*").alias("n")).first()["n"] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node on an edge (columns u, v: long).

    Each round hooks every node's larger neighbours, then its smaller ones, to
    the smallest node it sees; both are joins against a minimum per node, so a
    hub's rows are never gathered. The edges shrink to stars in O(log^2 n)
    rounds, and the loop ends with them only; each round's edges are kept in the checkpoint folder. Loops and
    repeated edges are allowed, null ends are not followed.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        # large star: neighbours larger than a node go to the smallest node it sees
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
