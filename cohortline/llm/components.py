"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.core.workspace import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = low.select("a", F.col("m").alias("b"))
    return moved.unionByName(kept).filter("a > b")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Root of every node that has a link: columns ``node`` and ``root`` (smallest node).

    ``edges`` has long columns ``a`` and ``b``; nulls, loops, repeats and either direction
    are allowed, and no edges give no rows. Every round writes its edges to the shared
    scratch folder, which cuts the lineage; the number of rounds grows with the logarithm
    of the longest path. Aggregates combine before they shuffle, and joins on a hub are
    split by adaptive execution. Only a count and a checksum reach the driver.
    """
    edges = edges.filter("a != b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges = materialise(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialise(_large_star(edges).distinct(), "edges")
        edges = materialise(_small_star(edges).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
