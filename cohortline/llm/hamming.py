"""Exact search for fingerprints that differ in few bits, split over many tasks.

Two 64-bit values that differ in at most d bits agree in one of d+1 blocks (pigeonhole).
Every value is sent to one group per block, by the block's value. A block value that very
many fingerprints share is split further by a second pigeonhole over the remaining bits.
How values are dealt out never changes which pairs are found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Fingerprints in one group, about.
GROUP_ROWS = 60_000
#: One fingerprint in so many is looked at to find block values to split.
LOOK_EVERY = 32
#: Most block values that are split (those with the most fingerprints).
HOT_VALUES = 4096

ROUTE_SCHEMA = "block int, sub int, bucket int"


def block_ranges(d: int, low: int = 0, width: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of d+1 nearly equal blocks of ``width`` bits."""
    edges = [low + width * i // (d + 1) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _value(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def sub_ranges(d: int, block: int) -> list[list[tuple[int, int]]]:
    """d+1 sub-blocks of the bits outside ``block``, each a list of bit ranges."""
    first, width = block_ranges(d)[block]
    outside = [i for i in range(64) if not first <= i < first + width]
    found = []
    for start, size in block_ranges(d, 0, len(outside)):
        bits, ranges = outside[start : start + size], []
        for bit in bits:
            if ranges and ranges[-1][0] + ranges[-1][1] == bit:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((bit, 1))
        found.append(ranges)
    return found


def routed(codes: DataFrame, d: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per code and block (or sub-block): ``block, sub, bucket`` and all columns.

    ``codes`` is a stored table with a long column ``code``. Its rows are counted, and a
    share of them picked by hash shows which block values to split.
    """
    buckets = max(1, -(-codes.count() // group_rows))
    ranges = block_ranges(d)
    values = F.array(*(_value(F.col("code"), a, w) for a, w in ranges))
    spread = codes.select("*", F.posexplode(values).alias("block", "value"))
    seen = spread.filter(F.pmod(F.xxhash64("code"), F.lit(LOOK_EVERY)) == 0)
    hot = (
        seen.groupBy("block", "value")
        .count()
        .filter(F.col("count") * LOOK_EVERY > group_rows)
        .orderBy(F.desc("count"), "block", "value")
        .limit(HOT_VALUES)
        .select("block", "value")
        .collect()
    )
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")
    if not hot:
        plain = spread.withColumn("sub", F.lit(-1)).withColumn("bucket", bucket)
        return plain.drop("value")
    listed = codes.sparkSession.createDataFrame(
        [(r["block"], r["value"], True) for r in hot], "block int, value long, hot boolean"
    )
    spread = spread.join(F.broadcast(listed), ["block", "value"], "left")
    per_block = []
    for block in range(d + 1):
        subs = [
            F.xxhash64(F.col("value"), *(_value(F.col("code"), a, w) for a, w in sub))
            for sub in sub_ranges(d, block)
        ]
        per_block.append(F.array(*subs))
    subs = F.element_at(F.array(*per_block), F.col("block") + 1)
    plain = spread.filter(F.col("hot").isNull())
    plain = plain.withColumn("sub", F.lit(-1)).withColumn("bucket", bucket)
    split = spread.filter(F.col("hot").isNotNull())
    split = split.select("*", F.posexplode(subs).alias("sub", "_key"))
    split = split.withColumn("bucket", F.pmod("_key", F.lit(buckets)).cast("int")).drop("_key")
    return plain.unionByName(split).drop("hot", "value")


def in_groups(routes: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel(block, table) -> table`` on every group of routed codes."""

    def run(key, table):
        return kernel(key[0].as_py(), table)

    return routes.groupBy("block", "sub", "bucket").applyInArrow(run, schema)
