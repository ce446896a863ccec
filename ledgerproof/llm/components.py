"""Connected components of a link table, by alternating star contraction.

Each round rewires links toward the smallest node (large star, then small star), so a
component becomes a star in a number of rounds that grows with the logarithm of its size.
Links stay in tables in the shared folder; the driver sees two totals a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.session import durable


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    least = _smallest(links)
    rewired = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rewired.unionByName(least.select("a", F.col("m").alias("b")))


def _total(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Node and root (the smallest node that can be reached) for each node with a link.

    Nodes are longs. Loops, repeated links, links in both directions and links with a
    missing end are allowed; the last count for nothing. A node without links has no row.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    links = durable(links.distinct())
    before, now = None, _total(links)
    while before != now:
        links = durable(_small_star(durable(_large_star(links).distinct())).distinct())
        before, now = now, _total(links)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
