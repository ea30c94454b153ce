"""Silhouette widths: how well each row fits its cluster.

Two measures, never mixed: ``squared`` uses squared Euclidean distance, whose
cluster means follow from per-cluster sums, so the work is linear in the rows
for any number of clusters. ``euclidean`` uses plain distances and compares all
rows block by block, each pair of blocks once; it is exact and quadratic.

The sums of the clusters are a stored table. Rows meet it block by block: a block
of labels is sent to all tasks, and each row keeps its own cluster's mean and the
nearest other one seen so far.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.skew import lookup_join
from cohortline.core.workspace import materialise
from cohortline.operators.distance import SLICE_ROWS, in_blocks

#: Labels whose sums a task holds at once.
BLOCK_LABELS = 4096
#: Of a block of rows that meets others: most rows, numbers in its vectors, and sums by row and label.
PAIRED_ROWS, PAIRED_NUMBERS, PAIRED_SUMS = 40_000, 2_560_000, 1_000_000
#: Rows of a block that a slice of the other one is compared with at once.
TILE_ROWS = 1024
#: Least share of two squared lengths that a squared distance must have to follow from products.
APART = 1e-4


def vector_sums(vector: str, width: int) -> list[Column]:
    """Aggregates over vectors of one width: rows, sum of squares, sums per place."""
    places = [F.col(vector)[i].cast("double") for i in range(width)]
    square = reduce(lambda a, b: a + b, [p * p for p in places], F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(square).alias("squares"),
        F.array(*[F.sum(p) for p in places]).alias("sums"),
    ]


def label_sums(df: DataFrame, label: str, vector: str = "x") -> DataFrame:
    """Stored table of rows, sum of squares and coordinate sums per label."""
    first = df.select(F.size(vector)).first()
    width = first[0] if first else 0
    return materialise(df.groupBy(label).agg(*vector_sums(vector, width)), "label-sums")


def _against(rows: np.ndarray, squares: np.ndarray, sums: np.ndarray) -> Callable:
    """Mean squared distance of vectors to each of some clusters, and to the own one without itself."""

    def means(x: np.ndarray, own: np.ndarray):
        import numpy as np

        total = np.maximum(rows * (x**2).sum(axis=1)[:, None] + squares - 2 * x @ sums.T, 0.0)
        line = np.flatnonzero(own >= 0)
        inside = np.full(len(x), np.nan)
        inside[line] = total[line, own[line]] / np.maximum(rows[own[line]] - 1, 1)
        outside = total / rows
        outside[line, own[line]] = np.inf
        return inside, outside

    return means


def squared_silhouette(
    df: DataFrame, key: str, label: str, vector: str = "x", block_labels: int = BLOCK_LABELS
) -> DataFrame:
    """(key, label, neighbour, width) by squared Euclidean distance, for any number of labels.

    Rows are read once for the sums and once for the widths; the second pass goes through
    one block of labels after the other. A cluster of one row has width 0, as has every row if
    there is no other cluster (its neighbour is missing then). Labels must not be missing.
    """
    stored = label_sums(df, label, vector)
    blocks = max(1, -(-stored.count() // block_labels))
    dealt = stored.withColumn("_block", F.pmod(F.xxhash64(label), F.lit(blocks)))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    state = "_inside double, _held long, _gap double, neighbour " + types[label]
    schema = f"{key} {types[key]}, {label} {types[label]}, {vector} {types[vector]}, {state}"
    missing = {"_inside": "double", "_held": "long", "_gap": "double", "neighbour": types[label]}
    seen = df.select(key, label, vector, *[F.lit(None).cast(t).alias(n) for n, t in missing.items()])
    for block in range(blocks):
        # About ``block_labels`` rows of sums.
        part = dealt.filter(F.col("_block") == block).orderBy(label).toPandas()
        if len(part):
            seen = seen.mapInPandas(_nearer(part, key, label, vector), schema)
    inside, gap, held = F.col("_inside"), F.col("_gap"), F.col("_held")
    larger = F.greatest(inside, gap)
    alone = (held < 2) | (larger == 0) | gap.isNull()
    width = F.when(alone, 0.0).otherwise((gap - inside) / larger)
    return seen.select(key, label, "neighbour", width.alias("width"))


def _nearer(part: pd.DataFrame, key: str, label: str, vector: str) -> Callable:
    """Bring the clusters of one block into what each row knows of its own and the nearest other."""
    names, rows = part[label].to_numpy(), part["rows"].to_numpy(float)
    sums = np.stack(part["sums"].to_numpy()).astype(float)
    means = _against(rows, part["squares"].to_numpy(float), sums)
    place = {name: i for i, name in enumerate(names)}

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            # Small slices: each is compared with all labels of the block.
            for start in range(0, len(batch), 1000):
                piece = batch.iloc[start : start + 1000].reset_index(drop=True)
                x = np.stack(piece[vector].to_numpy()).astype(float)
                own = np.array([place.get(v, -1) for v in piece[label]])
                inside, outside = means(x, own)
                mine = own >= 0
                piece["_inside"] = np.where(mine, inside, piece["_inside"].astype(float))
                held = pd.Series(np.where(mine, rows[own], piece["_held"].astype(float))).astype("Int64")
                near = outside.argmin(axis=1)
                gap = outside[np.arange(len(x)), near]
                known = piece["_gap"].astype(float).to_numpy()
                # The smaller name on a tie.
                before = piece["neighbour"].to_numpy()
                tied = (gap == known) & np.array([b is not None and b == b and n < b for n, b in zip(names[near], before)])
                closer = np.isfinite(gap) & (np.isnan(known) | (gap < known) | tied)
                gaps = np.where(closer, gap, known)
                found = [n if c else (b if b == b else None) for n, c, b in zip(names[near].tolist(), closer, before)]
                yield pd.DataFrame(
                    {
                        key: piece[key],
                        label: piece[label],
                        vector: piece[vector],
                        "_inside": piece["_inside"],
                        "_held": held,
                        "_gap": pd.Series(gaps),
                        "neighbour": pd.Series(found, dtype=object),
                    }
                )

    return update


def nested_silhouettes(
    df: DataFrame, finest: str, cuts: DataFrame, vector: str = "x", most: int = BLOCK_LABELS
) -> DataFrame:
    """(k, mean_silhouette) of every cut of a given hierarchy, by squared Euclidean distance.

    ``cuts`` (finest, k, cut) says, for each ``k``, which cluster every ``finest`` label belongs to. One pass adds
    up the finest labels; the sums of all cuts are rolled up from them by the mapping. A second
    pass scores all cuts. The clusters of all cuts together must be at most ``most``.
    """
    sums = label_sums(df, finest, vector)
    first = sums.select(F.size("sums")).first()
    width = first[0] if first else 0
    places = [F.sum(F.col("sums")[i]) for i in range(width)]
    rolled = sums.join(cuts, finest).groupBy("k", "cut").agg(
        F.sum("rows").alias("rows"), F.sum("squares").alias("squares"), F.array(*places).alias("sums")
    )
    held = rolled.orderBy("k", "cut").limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"the cuts have more than {most} clusters together: score fewer at once")
    scored = []
    for k, part in held.groupby("k"):
        sums_k = np.stack(part["sums"].to_numpy()).astype(float)
        numbers = part["rows"].to_numpy(float)
        means = _against(numbers, part["squares"].to_numpy(float), sums_k)
        scored.append((int(k), {v: i for i, v in enumerate(part["cut"])}, numbers, means))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for start in range(0, len(batch), 1000):
                piece = batch.iloc[start : start + 1000]
                x, found = np.stack(piece[vector].to_numpy()).astype(float), []
                for (k, place, rows, means), chosen in zip(scored, np.stack(piece["own"].to_numpy()).T):
                    own = np.array([place[v] for v in chosen])
                    inside, outside = means(x, own)
                    gap = outside.min(axis=1)
                    larger = np.maximum(inside, gap)
                    known = (rows[own] > 1) & (larger > 0) & np.isfinite(gap)
                    total = ((gap[known] - inside[known]) / larger[known]).sum()
                    found.append((k, float(total), len(x)))
                yield pd.DataFrame(found, columns=["k", "total", "rows"])

    # The labels of a row at every cut, in the order of the cuts.
    listed = cuts.groupBy(finest).agg(F.sort_array(F.collect_list(F.struct("k", "cut"))).alias("at"))
    named = listed.select(finest, F.transform("at", lambda e: e["cut"]).alias("own"))
    rows = lookup_join(df.select(finest, vector), named, finest).select(vector, "own")
    parts = rows.mapInPandas(score, "k int, total double, rows long")
    return parts.groupBy("k").agg((F.sum("total") / F.sum("rows")).alias("mean_silhouette"))


def _euclidean() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Euclidean distances between the rows of two matrices, for use inside tasks.

    Squares follow from products of the vectors. Where that loses digits, as for rows that are
    nearly equal, the differences are squared instead.
    """
    share = APART

    def distances(a, b):
        import numpy as np

        with np.errstate(all="ignore"):
            firm = b[np.isfinite(b).all(axis=1)]
            centre = firm.sum(axis=0) / max(len(firm), 1)
            p, q = a - centre, b - centre
            p2, q2 = (p * p).sum(axis=1), (q * q).sum(axis=1)
            squared = np.c_[-2 * p, p2, np.ones(len(p))] @ np.c_[q, np.ones(len(q)), q2].T
            # Not so either where a number is missing or infinite.
            if not squared.min() >= share * (p2.max() + q2.max()):
                scale = np.add.outer(p2, q2)
                left, right = np.nonzero(~((squared >= share * scale) & np.isfinite(squared)))
                step = max(1, (1 << 20) // max(a.shape[1], 1))
                for start in range(0, len(left), step):
                    i, j = left[start : start + step], right[start : start + step]
                    squared[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
            return np.sqrt(squared, out=squared)

    return distances


def euclidean_silhouette(
    df: DataFrame, key: str, label: str, vector: str = "x", block_rows: int | None = None
) -> DataFrame:
    """(key, label, neighbour, width) by Euclidean distance between all rows.

    ``key`` must be unique. Every two blocks of rows meet once. The distances of a block pair are
    summed per label inside the task, for the rows of both; sums, not pairs, are shuffled. The
    size of a block follows from the width of the vectors and the number of labels unless given,
    so a task holds no more for wide vectors or many labels.
    """
    stored = materialise(df.select(key, label, vector), "silhouette")
    sizes = materialise(stored.groupBy(F.col(label).alias("other")).agg(F.count(F.lit(1)).alias("rows")), "label-rows")
    if block_rows is None:
        width = stored.agg(F.max(F.size(vector))).first()[0] or 1
        fitting = min(PAIRED_NUMBERS // max(width, 1), PAIRED_SUMS // max(sizes.count(), 1))
        block_rows = max(math.isqrt(PAIRED_SUMS), min(PAIRED_ROWS, fitting))
    types = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    schema = f"{key} {types[key]}, {label} {types[label]}, other {types[label]}, total double"
    measure, slice_rows, tile_rows = _euclidean(), SLICE_ROWS, TILE_ROWS

    def by_label(rows):
        """Rows in the order of their labels, their vectors, codes, and the names behind these."""
        import numpy as np
        import pandas as pd

        codes, names = pd.factorize(rows[label], sort=True)
        codes = np.arange(len(names))[codes]
        order = np.argsort(codes, kind="stable")
        rows = rows.iloc[order]
        return rows, np.stack(rows[vector].to_numpy()).astype(float), codes[order], names

    def listed(rows, total, names):
        import numpy as np
        import pandas as pd

        return pd.DataFrame(
            {
                key: np.repeat(rows[key].to_numpy(), len(names)),
                label: np.repeat(rows[label].to_numpy(), len(names)),
                "other": np.tile(names, len(rows)),
                "total": total.ravel(),
            }
        )

    def sums(pair, left, right):
        import numpy as np
        import pandas as pd

        if not (len(left) and len(right)):
            return pd.DataFrame({key: [], label: [], "other": [], "total": []})
        left, a, a_codes, a_names = by_label(left)
        right, b, b_codes, b_names = by_label(right)
        # A block against itself gives all its sums from one side.
        both = pair[0] != pair[1]
        to_b, to_a = np.zeros((len(a), len(b_names))), np.zeros((len(b), len(a_names)))
        starts = lambda codes: np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        for j in range(0, len(b), tile_rows):
            tile = slice(j, j + tile_rows)
            b_cuts = starts(b_codes[tile])
            for i in range(0, len(a), slice_rows):
                part = slice(i, i + slice_rows)
                found = measure(a[part], b[tile])
                to_b[part, b_codes[tile][b_cuts]] += np.add.reduceat(found, b_cuts, axis=1)
                if both:
                    a_cuts = starts(a_codes[part])
                    to_a[tile, a_codes[part][a_cuts]] += np.add.reduceat(found, a_cuts, axis=0).T
        found = listed(left, to_b, b_names)
        return pd.concat([found, listed(right, to_a, a_names)]) if both else found

    totals = in_blocks(stored, key, sums, schema, block_rows)
    per_label = totals.groupBy(key, label, "other").agg(F.sum("total").alias("total"))
    own = F.col("other") == F.col(label)
    means = per_label.join(sizes, "other").groupBy(key, label).agg(
        F.max(F.when(own, F.col("total") / F.greatest(F.col("rows") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(own, F.col("rows"))).alias("rows"),
        F.min(
            F.when(~own, F.struct((F.col("total") / F.col("rows")).alias("b"), "other"))
        ).alias("near"),
    )
    a, b = F.col("a"), F.col("near.b")
    width = F.when(F.col("rows") < 2, 0.0).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    return means.select(key, label, F.col("near.other").alias("neighbour"), width.alias("width"))


def mean_silhouette(widths: DataFrame, label: str) -> DataFrame:
    """Rows and mean width per cluster."""
    return widths.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("width").alias("mean_width")
    )
