"""Connected components of a graph of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import drop_scratch, materialized


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest vertex of each vertex's component, for links (a, b): v, component.

    Large and small stars in turn: each vertex's larger neighbours move to its smallest neighbour, then its smaller ones
    do, until nothing moves; the number of rounds grows with the logarithm of the longest path. Neighbours are
    never gathered, so a vertex may have any number of them. Vertices without a link, and links with a null end, give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, state = materialized(edges, "edges"), None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = materialized(small.filter("a > b").distinct(), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_scratch(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
