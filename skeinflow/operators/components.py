"""Connected components of a link table, by alternating star contractions.

Each round joins the links with each node's smallest neighbour, so that no
group of neighbours is ever gathered; a node with very many links is a skewed
join, which adaptive execution splits.  Rounds are written to the shared
folder.  A component's label is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def connected_components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """node, component for every node with a link to another one; links with null ends or to themselves don't count."""
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u is not null and v is not null and u != v").distinct()
    edges = scratch.keep(edges, "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: a node's larger neighbours go to the smallest of it and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        old, edges = edges, scratch.keep(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        scratch.drop(old)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
