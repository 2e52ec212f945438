"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.plans.shared import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node that a path reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step shuffles the links
    once, and their number never grows. A node with very many links is settled by a map-side minimum,
    and the join that hands it out can be split. Each step is written to the shared folder. Nodes
    without a link, and links to themselves, give no row.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "large-star")
        # small star: a node's smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        small = materialize(small.where("a <> b").distinct(), "small-star")
        digest = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = digest(small) == digest(edges)
        discard(edges.sparkSession, large)
        discard(edges.sparkSession, edges)
        edges = small
        if done:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
