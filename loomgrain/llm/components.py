"""Connected components of a link table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: each joins every node's links
    with the smallest of its neighbours, so the number of links never grows, and
    the rounds grow with the logarithm of the longest path. Each round is a
    written table, and so are the smallest neighbours that it is joined with, so
    that both sides of these joins are dealt anew and a hub's links can be split.
    Links of a node to itself and repeated links change nothing; nulls are not nodes.
    """
    edges = materialise(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the smallest one, or to the node itself; links lead down, so they are read as they are, not both ways
        least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), "large-star-least")
        larger = edges.join(least, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialise(larger, "large-star")
        # small star: the smaller neighbours and the node itself are linked to the smallest one
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), "small-star-least")
        smaller = large.join(least, F.col("a") == F.col("n"))
        new = materialise(
            smaller.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "small-star",
        )
        # a star forest: each node has one link down, and none that has one has a link from above
        ends = new.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(new.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty():
            pairs = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
        edges = new
    raise RuntimeError(f"no star forest after {max_rounds} rounds")
