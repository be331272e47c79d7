"""Connected components of a graph of links by alternating large and small stars.

Each round is two joins on the node with a pre-aggregated minimum, so no neighbourhood is ever
gathered in one place; the rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a > b. Returns node, root: each node that is not the least of its component, and that least node.

    Repeated links do no harm; an empty table gives an empty result.
    """
    links = written(links.distinct(), "links")
    seen = None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, last = state, links
        links = written(_small_star(_large_star(last)), "links")
        discard(last)
