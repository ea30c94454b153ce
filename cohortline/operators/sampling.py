"""Samples of an exact size, the same for any layout of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.workspace import materialise

#: Bits of the draw that one histogram tells apart, and of the whole draw.
BITS, DRAW_BITS = 10, 60


def draw(key: Column, seed: str = "") -> Column:
    """A whole number below 2^60 that depends on the key and the seed only: an MD5 prefix."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _bound(drawn: DataFrame, count: int) -> int:
    """The smallest draw such that ``count`` rows lie at or below it.

    Each pass counts the rows of the current range by the next bits, at most ``2 ** BITS`` numbers,
    and goes on in the part that holds the row looked for: nothing is sorted or gathered.
    """
    low, width, before = 0, DRAW_BITS, 0
    while width:
        width -= BITS
        inside = drawn.filter((F.col("draw") >= low) & (F.col("draw") < low + (1 << width + BITS)))
        parts = inside.groupBy(F.shiftright("draw", width).alias("part")).count()
        for part, rows in sorted((r["part"], r["count"]) for r in parts.collect()):
            if before + rows >= count:
                low = part << width
                break
            before += rows
        if rows == 1:
            return inside.filter(F.shiftright("draw", width) == part).first()["draw"]
    return low


def exact_sample(df: DataFrame, key: str, count: int, seed: str = "") -> DataFrame:
    """``count`` rows of ``df`` (all, if it has no more), drawn without replacement by their key.

    ``key`` must tell the rows apart and must not be missing. The draw follows the MD5 of seed and
    key, so it needs no sort, does not depend on partitions, and a smaller sample is part of a
    larger one.
    """
    if count <= 0:
        return df.limit(0)
    drawn = materialise(df.select(draw(F.col(key), seed).alias("draw")), "draws")
    if drawn.count() <= count:
        return df
    return df.filter(draw(F.col(key), seed) <= _bound(drawn, count))
