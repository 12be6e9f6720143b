"""Connected components of a table of links, by alternating stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelayer.llm.scratch import Scratch
from orelayer.session import written


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is tied to the least one of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.write(both.groupBy("a").agg(F.min("b").alias("least")), "least-neighbours")
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; links run from the larger node to the smaller."""
    least = scratch.write(links.groupBy("a").agg(F.min("b").alias("least")), "least-neighbours")
    moved = links.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(found)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node it is linked with) for nodes that are not their own label.

    ``links`` has columns ``a`` and ``b``; order, repeats and links to itself do not matter. Each round is written to the
    shared folder, so a lost executor costs a round at most; stars need a few rounds however long a chain is.
    """
    ends = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, links = None, written(ends.distinct(), "links")
    while (now := _state(links)) != state:
        state = now
        if not now[0]:
            break
        # What a round writes goes when its result is written.
        scratch = Scratch(links.sparkSession, "stars")
        large = scratch.write(_large_star(links, scratch), "large-star")
        links = written(_small_star(large, scratch), "links")
        scratch.drop()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
