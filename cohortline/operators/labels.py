"""Readable cluster labels, extents and profiles.

Tables with one row per cluster are small, so they are ranked in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortline.core.skew import lookup_join
from cohortline.core.workspace import materialise
from cohortline.functions.aggregates import half_even
from cohortline.functions.columns import named
from cohortline.functions.distribution import (
    group_medians,
    group_quantiles,
    rank_intervals,
    trimmed_mean,
)

SPREAD = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def cluster_names(df: DataFrame, coarse: str, fine: str, measure: str) -> DataFrame:
    """(coarse, fine, coarse_rank, fine_rank, cluster) of every fine cluster.

    Coarse clusters are ranked by their median ``measure``, fine ones by theirs
    inside their coarse cluster; the name is ``"<coarse_rank>.<fine_rank>"``.
    """
    # Each row counts at both levels, so one pass ranks both.
    outer_key = F.struct(F.lit(1).alias("level"), F.col(coarse), F.lit(None).alias(fine))
    inner_key = F.struct(F.lit(2).alias("level"), F.col(coarse), F.col(fine))
    both = df.select(F.inline(F.array(outer_key, inner_key)), measure)
    medians = group_medians(both, ["level", coarse, fine], measure)
    outer = medians.filter("level = 1").select(
        coarse,
        F.row_number().over(Window.orderBy("median", coarse)).alias("coarse_rank"),
    )
    inner = medians.filter("level = 2").select(
        coarse,
        fine,
        F.row_number()
        .over(Window.partitionBy(coarse).orderBy("median", fine))
        .alias("fine_rank"),
    )
    name = F.concat_ws(".", F.col("coarse_rank").cast("string"), F.col("fine_rank").cast("string"))
    return inner.join(outer, coarse).withColumn("cluster", name)


def canonical_labels(df: DataFrame, coarse: str, fine: str, measure: str) -> DataFrame:
    """``df`` with the readable name of its fine label in ``cluster``.

    ``fine`` labels must be nested: each belongs to one coarse label.
    """
    names = materialise(cluster_names(df, coarse, fine, measure), "names").select(fine, "cluster")
    return lookup_join(df, names, fine, "left")


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def cluster_extents(sizes: DataFrame, label: str, order: str) -> DataFrame:
    """(position, label, n, first, last): running row extents in the given order."""
    along = Window.orderBy(order)
    before = F.coalesce(
        F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return sizes.select(
        F.row_number().over(along).alias("position"),
        label,
        "n",
        (before + 1).alias("first"),
        (before + F.col("n")).alias("last"),
    )


def select_extents(
    extents: DataFrame, which: list[int] | None = None, x: list[float] | None = None
) -> DataFrame:
    """Extents by position (``which``), or those that hold a row position (``x``)."""
    if which is not None and x is not None:
        raise ValueError("pick clusters by their position (which) or by a row they hold (x), not both")
    if x is not None:
        # Position p holds x when the rows before it end strictly below x.
        held = [(F.col("first") - 1 < v) & (F.col("last") >= v) for v in x]
        last = extents.agg(F.max("last")).first()[0]
        if any(v <= 0 or v > last for v in x):
            raise ValueError(f"row positions x run from above 0 to {last}")
        test = held[0]
        for other in held[1:]:
            test = test | other
        return extents.filter(test)
    if which is None:
        return extents
    count = extents.count()
    if any(not 1 <= w <= count for w in which):
        raise ValueError(f"cluster positions run from 1 to {count}")
    return extents.filter(F.col("position").isin(which))


def members(df: DataFrame, label: str, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen clusters."""
    return lookup_join(df, chosen.select(label).distinct(), label, "left_semi")


def trimmed_mean_by_group(
    df: DataFrame, group: str, columns: list[str], trim: float = 0.3
) -> DataFrame:
    """(group, dim, score): trimmed mean of every column in every group."""
    pairs = [
        F.struct(F.lit(c).alias("dim"), named(c).cast("double").alias("score")) for c in columns
    ]
    long = df.select(group, F.inline(F.array(*pairs)))
    ranks = rank_intervals(long, [group, "dim"], "score")
    return ranks.groupBy(group, "dim").agg(trimmed_mean(trim).alias("score"))


def cluster_profile(
    patients: DataFrame, label: str, dims: list[str], trim: float = 0.3, above: float = 1.0
) -> DataFrame:
    """Share of minutes per activity and cluster, for shares above ``above`` percent.

    (label, cluster_rank, dim, score, mins, hours): trimmed means of the shares
    and of the minutes; clusters are ranked by minutes.
    """
    shares = [
        (F.try_divide(named(f"mins_{d}"), F.col("mins")) * 100).alias(f"mins_{d}") for d in dims
    ]
    table = patients.select(label, "mins", *shares)
    means = trimmed_mean_by_group(table, label, ["mins", *[f"mins_{d}" for d in dims]], trim)
    total = means.filter(F.col("dim") == "mins").select(label, F.col("score").alias("mins"))
    kept = (
        means.filter((F.col("dim") != "mins") & (F.col("score") > above))
        .withColumn("dim", F.expr("substring(dim, 6)"))
        .join(total, label)
    )
    ranked = F.dense_rank().over(Window.orderBy("mins", label)).alias("cluster_rank")
    return kept.select(
        label, ranked, "dim", "score", "mins", half_even(F.col("mins") / 60).alias("hours")
    )


def spread_by_cluster(df: DataFrame, label: str, value: str) -> DataFrame:
    """Quantiles of the positive values per cluster: (label, n, p05 … p95)."""
    return group_quantiles(df.filter(F.col(value) > 0), [label], value, SPREAD)


def hours_by_cluster(patients: DataFrame, label: str) -> DataFrame:
    hours = patients.select(label, (F.col("mins") / 60).alias("hours"))
    return spread_by_cluster(hours, label, "hours")


def costs_by_cluster(patients: DataFrame, label: str) -> DataFrame:
    costs = patients.select(label, (F.col("costs") / 1000).alias("costs"))
    return spread_by_cluster(costs, label, "costs")
