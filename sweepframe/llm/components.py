"""Connected components of links by alternating stars.

Each round links the larger neighbours of a node to the smallest one around it, then
each node's smaller neighbours among themselves, until the links are stars around the
smallest node of each component. A round is sums and joins of links; nothing of a
component is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.session import write_table


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (a, b) that is not its own root.

    Nodes are numbers; the root is the smallest node of the component. Runs jobs: one
    table for each round, of which there are about as many as the logarithm of the
    longest chain.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = write_table(links.distinct(), "links").df
    state = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or seen == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        # sums are written before they are joined, so that a node with many links can be split
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least").df
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_table(large.distinct(), "large").df
        least = write_table(large.groupBy("a").agg(F.min("b").alias("m")), "least").df
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = write_table(
            moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links"
        ).df
