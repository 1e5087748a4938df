"""Connected components over links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the node's smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, get linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``a``, ``root``: for each linked node that isn't the smallest of its component, the smallest one.

    ``links`` (``a``, ``b``) are undirected; repeated links and loops do no harm.  Rounds
    of the large-star and small-star steps end when each node hangs on its root; the
    number of rounds grows with the logarithm of the longest path.  Each round is written
    to the shared folder; only the count and a checksum of its links come to the driver.
    Minima are combined before the shuffle and joins on a hub are split by Spark.
    """
    current = materialize(links.select("a", "b").filter(F.col("a") != F.col("b")), "links")
    before = None
    while True:
        current = materialize(_small_star(_large_star(current)), "links")
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == before:
            return current.select("a", F.col("b").alias("root"))
        before = state
