"""Ward merges on Spark: rounds of mutual nearest neighbours.

Of every cluster A a row keeps the sums of all distances S(A, B) to the others. Ward's update of (unsquared) dissimilarities says that their gap is

    |A||B| / (|A|+|B|) * (2 S(A,B) / |A||B| - S(A,A) / |A|² - S(B,B) / |B|²)

so merging two clusters only adds their sums. Ward linkage is reducible: two clusters that are
each other's nearest merge in the end whatever else merges first. So each round merges all such
pairs at once, by one grouped sum, and the merges put in order of height are those of
the tree built one by one. Every round merges at least the closest pair; in practice about a
third of the clusters. ``a`` is the smallest leaf of a merge's first part and names
the merged cluster, ``b`` that of the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.core.workspace import materialise

#: Groups in which the rows of sums are added up.
GROUPS = 16
#: So few clusters are merged to the end in one place.
FEW = 128


@dataclass(frozen=True)
class Merges:
    """``leaves`` (node, rows) and ``table`` (step, a, b, a_node, b_node, height, size).

    Both are stored. Leaves are nodes 0…m-1; node m-1+step is the merge of that step.
    """

    leaves: DataFrame
    table: DataFrame
    count: int


def point_sums(spark: SparkSession, points: np.ndarray, sizes: np.ndarray, grid: float) -> DataFrame:
    """(node, totals): from each of a bounded number of points, the sum of the distances of its
    rows to those of every point.

    Distances count in steps of ``1 / grid``: whole numbers, so sums are the same in any order
    as long as doubles hold them.
    """

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for a in batch["id"]:
                gap = np.sqrt(((points - points[a]) ** 2).sum(axis=1))
                totals = np.rint(gap * grid) * sizes[a] * sizes
                yield pd.DataFrame({"node": [a], "totals": [totals.tobytes()]})

    first = spark.range(len(points)).repartition(spark.sparkContext.defaultParallelism)
    return first.mapInPandas(distances, "node long, totals binary")


def _round(rows: np.ndarray, own: np.ndarray, into: np.ndarray):
    """Group function: add the totals of the clusters that are one now, and find the nearest of each.

    ``rows`` is 0 and ``into`` another name for names that are gone; the smallest name wins a tie.
    """
    moved = np.flatnonzero(into != np.arange(len(into)))

    def add(held: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        names, place = np.unique(into[held["node"].to_numpy()], return_inverse=True)
        totals = np.zeros((len(names), len(rows)))
        np.add.at(totals, place, np.stack([np.frombuffer(t) for t in held["totals"]]))
        # A name takes in one other at most, so no column is added to twice.
        totals[:, into[moved]] += totals[:, moved]
        totals[:, moved] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            n, m = rows[names, None], rows[None, :]
            inside = own[names, None] / (n * n) + own / (m * m)
            gap = n * m / (n + m) * (2 * totals / (n * m) - inside)
        line = np.arange(len(names))
        gap[:, rows == 0] = gap[line, names] = np.inf
        near = gap.argmin(axis=1)
        found = {"node": names, "totals": [t.tobytes() for t in totals], "near": near}
        return pd.DataFrame({**found, "gap": gap[line, near], "total": totals[line, near]})

    return add


def ward_merges(leaves: DataFrame, sums: DataFrame, grid: float = 1.0) -> Merges:
    """The whole tree over ``leaves`` (node 0…m-1, rows) from their ``sums`` (node, totals).

    A leaf stands for rows at one place. Sums of all leaves are quadratic in their number, which
    the caller bounds; they stay on Spark. Sizes and merges, at most one a leaf, pass the driver.
    No leaves, or one, give no merges. Heights come in units of ``1 / grid`` of ``totals``.
    """
    spark = leaves.sparkSession
    leaves = materialise(leaves.select("node", "rows"), "leaves")
    rows = np.array([float(r["rows"]) for r in leaves.orderBy("node").collect()])
    count, own, into = len(rows), np.zeros(len(rows)), np.arange(len(rows))
    merges, turn = [], 0
    schema = "node long, totals binary, near long, gap double, total double"
    held = None
    while (left := np.count_nonzero(rows)) > 1:
        add = _round(rows, own, into)
        if left > FEW:
            # Both parts of a merge go to one group: by the name that they have now.
            now = spark.createDataFrame(pa.table({"node": np.arange(count), "to": into}))
            dealt = sums.join(F.broadcast(now), "node").withColumn("group", F.col("to") % GROUPS)
            groups = dealt.select("node", "totals", "group").groupBy("group")
            sums = materialise(groups.applyInPandas(add, schema), "sums")
            nearest = sums.select("node", "near", "gap", "total").toPandas()
        else:
            # So few that another job would only wait: the same step on their rows.
            held = add(sums.select("node", "totals").toPandas() if held is None else held)
            nearest = held
        found = {r.node: r for r in nearest.itertuples()}
        into = np.arange(count)
        for a, r in found.items():
            b = r.near
            if a < b and found[b].near == a:
                merges.append((r.gap, turn, a, b, int(rows[a] + rows[b])))
                own[a] += own[b] + 2 * r.total
                rows[a], rows[b], into[b] = rows[a] + rows[b], 0.0, a
        turn += 1
    # A merge is never lower than one inside it, but for rounding: rounds decide then.
    merges.sort(key=lambda r: (round(r[0], 6), *r[1:4]))
    now, steps = {}, []
    for step, (gap, _, a, b, size) in enumerate(merges, 1):
        steps.append((step, a, b, now.get(a, a), now.get(b, b), gap / grid, size))
        now[a] = count - 1 + step
    schema = "step int, a long, b long, a_node long, b_node long, height double, size long"
    return Merges(leaves, materialise(spark.createDataFrame(steps, schema), "merge-table"), count)


def labels(merges: Merges, cuts: dict[str, int]) -> DataFrame:
    """(node, one column per cut): labels 1…k of the leaves, numbered by smallest leaf; stored.

    A cut into k clusters undoes the last k - 1 merges, so finer cuts are nested in coarser
    ones. Each cut follows the names of its leaves in a group of its own.
    """
    for k in cuts.values():
        if not 1 <= k <= max(merges.count, 1):
            raise ValueError(f"k must be between 1 and {merges.count}")

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Later merges first: the name that a leaf gets has its own final name by then.
        to = {}
        for node, name in rows.sort_values("step", ascending=False)[["node", "to"]].itertuples(index=False):
            to[node] = to.get(name, name)
        number = {name: i for i, name in enumerate(sorted(set(to.values())), 1)}
        found = {"node": list(to), "label": [number[name] for name in to.values()]}
        return pd.DataFrame({"cut": int(key[0]), **found})

    listed = F.array(*[F.lit(merges.count - k) for k in cuts.values()])
    nodes = merges.leaves.select("node", F.posexplode(listed).alias("cut", "kept"))
    moves = merges.table.select(F.col("b").alias("node"), F.col("a").alias("to"), "step")
    moved = F.col("step") <= F.col("kept")
    to = nodes.join(F.broadcast(moves), "node", "left").select(
        "cut",
        "node",
        F.when(moved, F.col("to")).otherwise(F.col("node")).alias("to"),
        F.when(moved, F.col("step")).otherwise(F.lit(merges.count)).alias("step"),
    )
    numbered = to.groupBy("cut").applyInPandas(follow, "cut int, node long, label int")
    columns = [F.max(F.when(F.col("cut") == i, F.col("label"))).alias(n) for i, n in enumerate(cuts)]
    return materialise(numbered.groupBy("node").agg(*columns), "labels")


def clusters_for(merges: Merges, k: int | None = None, h: float | None = None) -> int:
    """Number of clusters asked for by a count or by a height; exactly one is given.

    A height asks for the first position, counting merges from the top, whose height is below
    it, and for two clusters at least.
    """
    if (k is None) == (h is None):
        raise ValueError("give the number of clusters k or the height h, not both or neither")
    total = merges.count - 1
    if h is not None:
        top = merges.table.filter(F.col("height") < h).agg(F.max("step")).first()[0]
        if top is None:
            raise ValueError(f"height {h} is not above any merge of the tree: pass a larger h")
        k = max(total - top + 1, 2)
    if not 2 <= k <= total:
        raise ValueError(f"pass a k from 2 to {total}, the number of merges")
    return k


def cluster_order(merges: Merges, k: int, label: str = "cluster") -> DataFrame:
    """(label, place) of the clusters of a cut, from left to right along the tree.

    Only the k - 1 highest merges matter; in each the part with the smaller node comes first.
    """
    named = labels(merges, {label: k}).groupBy(label).agg(F.min("node").alias("low"))
    of = {r["low"]: r[label] for r in named.collect()}
    top = merges.table.filter(F.col("step") > merges.count - k).collect()
    # k - 1 rows: a walk over them orders the clusters that they join.
    nodes = {merges.count - 1 + r["step"]: r for r in top}
    along, pending = [], [(2 * merges.count - 2, 0)] if of else []
    while pending:
        node, name = pending.pop()
        if node in nodes:
            row = nodes[node]
            pending += sorted([(row["a_node"], row["a"]), (row["b_node"], row["b"])], reverse=True)
        else:
            along.append(of[name])
    places = [(int(c), i + 1) for i, c in enumerate(along)]
    return merges.leaves.sparkSession.createDataFrame(places, f"{label} int, place int")


def merge_table(merges: Merges) -> DataFrame:
    """(step, left_node, right_node, height, size) of every merge."""
    nodes = F.least("a_node", "b_node").alias("left_node"), F.greatest("a_node", "b_node").alias("right_node")
    return merges.table.select("step", *nodes, "height", "size")
