"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planmark.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_lowest(links: DataFrame) -> DataFrame:
    """Each link with the lowest node among its first end and all that it is linked to."""
    low = links.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("of"), F.least("a", "low").alias("low")
    )
    return links.join(low, F.col("a") == F.col("of")).drop("of")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long, not null), root the lowest node reachable.

    Alternates two steps until the links stand still: every node hands its higher neighbours to its
    lowest one, then its lower ones. Links become stars around the roots, in a number of rounds that
    grows with the logarithm of the size. Each round is an aggregate and a join on the node, written
    to the shared folder; a node with very many links is one aggregated row on one side of the join.
    """
    links = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        large = _with_lowest(_both_ways(links)).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(large.distinct())
        small = _with_lowest(large)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b")))
        links = cut_lineage(small.filter("a <> b").distinct())
        found = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == found:
            break
        mark = found
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
