"""Exact order statistics per group for groups of any size.

A group may hold most of the rows, so no step sorts a whole group in one task.
Equal values are counted first. The counted values are laid out by value range
over partitions, the layout is stored, and each value gets the number of rows
before it: rows in earlier ranges plus rows before it in its own range.
Medians, quantiles and trimmed means are then plain conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortline.core.workspace import materialise


def rank_intervals(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, copies, before, total) for each distinct non-null value.

    The rows of a group sorted by ``value`` take the 0-based ranks
    ``before`` … ``before + copies - 1`` of ``total``.
    """
    # One struct as key: missing groups compare equal in the join below.
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(
            F.struct(*groups).alias("_group"), F.col(value).cast("double").alias("value")
        )
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # The range layout is stored: two passes must see the same ranges.
    laid = materialise(
        counted.repartitionByRange("_group", "value").withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    # At most one row per (group, range): as many as there are partitions and groups.
    by_group = Window.partitionBy("_group")
    earlier = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("_group", "_range").agg(F.sum("copies").alias("_held")).select(
        "_group",
        "_range",
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_held").over(by_group).alias("total"),
    )
    inside = (
        Window.partitionBy("_group", "_range")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = laid.withColumn("_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return local.join(ranges, ["_group", "_range"]).select(
        "_group.*",
        "value",
        "copies",
        (F.col("_offset") + F.col("_inside")).alias("before"),
        "total",
    )


def _value_at(rank: Column) -> Column:
    held = (F.col("before") <= rank) & (rank < F.col("before") + F.col("copies"))
    return F.max(F.when(held, F.col("value")))


def quantile(p: float) -> Column:
    """Linear-interpolation quantile; an aggregate over ``rank_intervals`` rows."""
    position = (F.col("total") - 1) * F.lit(float(p))
    low = _value_at(F.floor(position))
    high = _value_at(F.ceil(position))
    weight = F.max(position - F.floor(position))
    return low + (high - low) * weight


def trimmed_mean(trim: float) -> Column:
    """Mean without ``floor(trim * n)`` rows at each end; over ``rank_intervals`` rows."""
    cut = F.floor(F.col("total") * F.lit(float(trim)))
    upper = F.least(F.col("before") + F.col("copies"), F.col("total") - cut)
    lower = F.greatest(F.col("before"), cut)
    kept = F.greatest(upper - lower, F.lit(0))
    return F.sum(F.col("value") * kept) / F.sum(kept)


def group_quantiles(
    df: DataFrame, groups: list[str], value: str, names: dict[str, float]
) -> DataFrame:
    """One row per group with a quantile column for each entry of ``names``."""
    return rank_intervals(df, groups, value).groupBy(*groups).agg(
        F.max("total").alias("n"), *[quantile(p).alias(name) for name, p in names.items()]
    )


def group_medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return group_quantiles(df, groups, value, {"median": 0.5})


def group_trimmed_means(
    df: DataFrame, groups: list[str], value: str, trim: float, name: str
) -> DataFrame:
    return rank_intervals(df, groups, value).groupBy(*groups).agg(
        F.max("total").alias("n"), trimmed_mean(trim).alias(name)
    )
