"""Patients in clusters: micro-clusters on Spark, Ward merges over them.

Rows are first reduced to at most ``micro`` points by one method at every size: the
distinct coordinates of smallest hash start as centres, and a fixed number of steps
assigns all coordinates and averages them. Coordinates count in whole steps of ``1 / GRID``,
so that distances and sums are exact in any order: the points depend neither on how rows
are laid out nor on how they are batched. If there are no more coordinates than points, each is
its own centre and the merges are those of the full data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F

from cohortline.core.workspace import materialise
from cohortline.operators.merging import Merges, cluster_order, labels, point_sums, ward_merges
from cohortline.operators.silhouette import vector_sums

MICRO, STEPS = 2000, 5
#: Steps of a coordinate's unit. Coordinates of distances up to 1 stay exact in doubles.
GRID = 1 << 20
COARSE, FINE = 3, 9


@dataclass(frozen=True)
class Micro:
    """Points that stand for the rows (a bounded number), the rows behind each, and their merges."""

    points: np.ndarray
    sizes: np.ndarray
    merges: Merges
    exact: bool


def fit_micro(coordinates: DataFrame, micro: int = MICRO, steps: int = STEPS) -> Micro:
    """Reduce stored coordinates to at most ``micro`` points and merge these."""
    whole = F.transform("x", lambda v: F.round(v * GRID).cast("long"))
    distinct = coordinates.select(whole.alias("q")).groupBy("q").agg(F.count("*").alias("rows"))
    distinct = materialise(distinct, "distinct-coordinates")
    start = distinct.orderBy(F.xxhash64("q"), "q").limit(micro).collect()
    centres = np.array([row["q"] for row in start], dtype=float).reshape(len(start), -1)
    centres = np.unique(centres, axis=0) if centres.shape[1] else centres
    for _ in range(steps if centres.shape[1] else 0):
        held = _averaged(distinct, centres)
        moved = np.array([[round(s / r["rows"]) for s in r["sums"]] for r in held], dtype=float)
        if len(moved) == len(centres) and (moved == centres).all():
            break
        centres = np.unique(moved, axis=0)
    held = _averaged(distinct, centres)
    points = centres[[r["centre"] for r in held]] / GRID
    sizes = np.array([r["rows"] for r in held], dtype=float)
    exact = distinct.count() <= micro
    spark = coordinates.sparkSession
    leaves = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "node long, rows long")
    merges = ward_merges(leaves, point_sums(spark, points, sizes, GRID), GRID)
    return Micro(points, sizes, merges, exact)


def _averaged(distinct: DataFrame, centres: np.ndarray) -> list:
    """Rows and coordinate sums of each centre that is nearest to any; one row a centre."""
    dims = centres.shape[1]
    if not dims:
        rows = distinct.agg(F.sum("rows")).first()[0]
        return [Row(centre=0, rows=rows, sums=[])] if rows else []

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        norms = (centres**2).sum(axis=1)
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.iloc[first : first + 1000]
                q = np.stack(part["q"].to_numpy()).astype(float)
                # Whole numbers below 2**53 throughout, so ties are exact: the first centre wins.
                centre = (norms - 2 * (q @ centres.T)).argmin(axis=1)
                yield pd.DataFrame({"centre": centre, "q": part["q"], "rows": part["rows"]})

    placed = distinct.mapInPandas(nearest, "centre int, q array<long>, rows long")
    sums = F.array(*[F.sum(F.col("q")[i] * F.col("rows")) for i in range(dims)])
    held = placed.groupBy("centre").agg(F.sum("rows").alias("rows"), sums.alias("sums"))
    return sorted(held.collect(), key=lambda r: r["centre"])


def assign(coordinates: DataFrame, fitted: Micro, cuts: dict[str, int]) -> DataFrame:
    """Coordinates with the nearest point, its distance, and one label per cut.

    ``cuts`` maps column names to numbers of clusters. Labels of a finer cut are
    nested in those of a coarser one.
    """
    points = fitted.points
    kind = coordinates.schema["client_id"].dataType.simpleString()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        norms = (points**2).sum(axis=1)
        for batch in batches:
            # Small slices: a slice is compared with all points at once.
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                x = np.stack(part["x"].to_numpy())
                micro = (norms - 2 * x @ points.T).argmin(axis=1)
                dist = np.sqrt(((x - points[micro]) ** 2).sum(axis=1))
                held = {"client_id": part["client_id"], "x": part["x"], "micro": micro}
                yield pd.DataFrame({**held, "dist": dist})

    schema = f"client_id {kind}, x array<double>, micro int, dist double"
    placed = coordinates.select("client_id", "x").mapInPandas(nearest, schema)
    if not cuts:
        return placed
    # One row a point, so as many as ``fit_micro`` allows.
    named = F.broadcast(labels(fitted.merges, cuts).withColumn("node", F.col("node").cast("int")))
    return placed.join(named, placed["micro"] == named["node"]).select(*placed.columns, *cuts)


def _label_arrays(fitted: Micro, ks: list[int]) -> dict[int, np.ndarray]:
    """Labels 1…k of the points for every k, in the order of the points."""
    named = labels(fitted.merges, {f"k{k}": k for k in ks}).toPandas().sort_values("node")
    return {k: named[f"k{k}"].to_numpy(int) for k in ks}


def silhouette_sweep(
    coordinates: DataFrame, fitted: Micro, ks: list[int], method: str = "euclidean"
) -> DataFrame:
    """(k, mean_silhouette, method) for cuts into each of ``ks`` clusters.

    One pass over the rows scores all cuts. ``euclidean`` sums distances to the
    points, weighted by the rows behind them: exact if the points are, else each
    row counts at its point. ``squared`` uses squared distances and exact sums
    of the rows at any size.
    """
    ks = [k for k in ks if 2 <= k <= fitted.merges.count]
    # Cuts are nested: totals for the finest one are rolled up to the others.
    finest = max(ks, default=1)
    named = {k: v - 1 for k, v in _label_arrays(fitted, sorted({*ks, finest})).items()}
    fine = np.eye(finest)[named[finest]]
    placed = assign(coordinates, fitted, {}).select("x", "micro")
    if method == "euclidean":
        rows, points = fitted.sizes, fitted.points
        weights = fine * rows[:, None]

        def totals_of(x):
            import numpy as np

            squared = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T
            return np.sqrt(np.maximum(squared, 0.0)) @ weights

    elif method == "squared":
        rows, squares, sums = _point_sums(placed, fitted)
        counts, squares, sums = fine.T @ rows, fine.T @ squares, fine.T @ sums

        def totals_of(x):
            import numpy as np

            return np.maximum(counts * (x**2).sum(axis=1)[:, None] + squares - 2 * x @ sums.T, 0)

    else:
        raise ValueError(f"unknown method {method!r}")
    held = fine.T @ rows
    cuts = {}
    for k in ks:
        nested = np.zeros((finest, k))
        nested[named[finest], named[k]] = 1.0
        cuts[k] = (named[k], nested, nested.T @ held)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            # Small slices: a slice is compared with all points at once.
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                micro, line = part["micro"].to_numpy(), np.arange(len(part))
                total = totals_of(np.stack(part["x"].to_numpy()))
                found = []
                for k, (label, nested, n) in cuts.items():
                    own, sums_k = label[micro], total @ nested
                    inside = sums_k[line, own] / np.maximum(n[own] - 1, 1)
                    outside = np.where(n > 0, sums_k / np.where(n > 0, n, 1), np.inf)
                    outside[line, own] = np.inf
                    gap = outside.min(axis=1)
                    larger = np.maximum(inside, gap)
                    known = (n[own] > 1) & (larger > 0) & np.isfinite(gap)
                    width = (gap[known] - inside[known]) / larger[known]
                    found.append((k, float(width.sum()), len(part)))
                yield pd.DataFrame(found, columns=["k", "total", "rows"])

    parts = placed.mapInPandas(score, "k int, total double, rows long")
    return parts.groupBy("k").agg(
        (F.sum("total") / F.sum("rows")).alias("mean_silhouette"), F.lit(method).alias("method")
    )


def _point_sums(placed: DataFrame, fitted: Micro) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of squares and coordinate sums behind each point."""
    m, dims = fitted.points.shape
    # One row per point, so at most as many as ``fit_micro`` allows.
    held = placed.groupBy("micro").agg(*vector_sums("x", dims)).collect()
    rows, squares, sums = np.zeros(m), np.zeros(m), np.zeros((m, dims))
    for row in held:
        i = row["micro"]
        rows[i], squares[i], sums[i] = row["rows"], row["squares"], row["sums"]
    return rows, squares, sums


def choose_k(sweep: DataFrame) -> int:
    """The number of clusters with the best mean width, the smallest on a tie."""
    return sweep.orderBy(F.desc("mean_silhouette"), "k").first()["k"]


def micro_table(fitted: Micro, cuts: dict[str, int]) -> DataFrame:
    """(micro, rows, labels…) of every point."""
    held = fitted.merges.leaves.join(labels(fitted.merges, cuts), "node")
    return held.select(F.col("node").cast("int").alias("micro"), "rows", *cuts)


def tree_order(fitted: Micro, k: int, label: str = "cluster") -> DataFrame:
    """(label, place) of the clusters of a cut, from left to right along the tree."""
    return cluster_order(fitted.merges, k, label)
