"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long nodes -> (node, component), component the smallest
    node reachable; nodes without links to others do not appear.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest of them (Kiveris et al., 2014: large-star and small-star); the
    number of links never grows, and rounds grow with the log of the longest
    chain. Minima are pre-aggregated, so a node with very many links is no hot
    group, and every round is a stored table.
    """
    e = (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e, before = stored(e, "links"), None
    while True:
        digest = e.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if digest == before or not digest["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = digest
        e = stored(_small_star(_large_star(e)), "links")
