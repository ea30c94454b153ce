"""Aggregates with explicit rules for missing values and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sum_or_zero(column: Column) -> Column:
    """Sum that skips missing values; 0 if nothing is left."""
    return F.coalesce(F.sum(column), F.lit(0))


def sum_if_complete(column: Column) -> Column:
    """Sum that is missing as soon as one input is missing."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def half_even(column: Column, digits: int = 0) -> Column:
    """Round with ties to the even neighbour."""
    return F.bround(column, digits)


def first_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    keep: list[str],
    where: Column | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """The first row of each group by ``order``; ``keep`` breaks remaining ties.

    Written as a minimum over a struct, so every input partition sends at most
    one row per group and a very large group never meets in one task. Only rows
    that satisfy ``where`` can be first (none: missing values), and ``also`` names
    aggregates over all rows of the group, from the same pass.
    """
    ranked = []
    for i, name in enumerate(order):
        # A missing value sorts after all others.
        ranked += [F.col(name).isNull().alias(f"_null_{i}"), F.col(name).alias(f"_order_{i}")]
    row = F.struct(*ranked, *[F.col(c) for c in keep])
    best = F.min(row if where is None else F.when(where, row)).alias("_best")
    more = also or {}
    return df.groupBy(*keys).agg(best, *[c.alias(name) for name, c in more.items()]).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in keep], *more
    )
