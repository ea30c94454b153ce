"""Weighted Jaccard distance between profiles.

d(a, b) = 1 - sum(min(a, b)) / sum(max(a, b)), and 0 when both are all zero.

Rows are compared with a given table of profiles, with the profiles within a given distance
(found by prefix filter), or block by block when a statistic over *all* pairs is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.skew import measured
from cohortline.core.workspace import materialise

#: Profiles of a given table that are compared with at once.
ANCHORS = 1000
BLOCK_ROWS = 10_000
SLICE_ROWS = 128
#: Profiles of one prefix, about, that meet as many others in one task.
PART_ROWS = 2048
#: Most partitions that pairs of blocks are dealt to.
CELLS = 4096


def _weighted_jaccard() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The distance between the rows of two matrices, for use inside tasks."""
    rows = SLICE_ROWS

    def distances(a, b):
        import numpy as np

        found = np.empty((len(a), len(b)))
        # Short slices stay in the processor cache.
        for start in range(0, len(a), rows):
            part = a[start : start + rows]
            low = np.zeros((len(part), len(b)))
            both = np.zeros((len(part), len(b)))
            for j in range(a.shape[1]):
                low += np.minimum.outer(part[:, j], b[:, j])
                both += np.add.outer(part[:, j], b[:, j])
            # Smaller and larger values add up to both.
            share = np.divide(low, both - low, out=np.ones_like(low), where=both != low)
            found[start : start + rows] = 1.0 - share
        return found

    return distances


weighted_jaccard = _weighted_jaccard()


def anchor_distances(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(client_id, anchor_id, dist) of every row to every profile of a given table.

    ``anchors`` has (anchor_id, x). It is gone through ``ANCHORS`` profiles at a time, in the
    order of their ids, so a task never holds more; rows are read once for each block.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((vectors, "client_id"), (anchors, "anchor_id"))]
    schema = f"client_id {kinds[0]}, anchor_id {kinds[1]}, dist double"
    stored = materialise(anchors.select("anchor_id", "x"), "anchors")
    blocks = max(1, -(-stored.count() // ANCHORS))
    held = stored.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        # A block by hash: at most about ``ANCHORS`` profiles.
        rows = held.filter(F.col("block") == block).orderBy("anchor_id").collect()
        found = vectors.mapInPandas(_to_anchors([r["anchor_id"] for r in rows], [r["x"] for r in rows]), schema)
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def _to_anchors(ids: list, rows: list) -> Callable:
    measure, rows = _weighted_jaccard(), np.array(rows, dtype=float)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            # Short slices: each row gives as many results as there are anchors.
            for start in range(0, len(batch) if len(ids) else 0, SLICE_ROWS):
                part = batch.iloc[start : start + SLICE_ROWS]
                found = measure(np.stack(part["x"].to_numpy()), rows)
                yield pd.DataFrame(
                    {
                        "client_id": np.repeat(part["client_id"].to_numpy(), len(ids)),
                        "anchor_id": np.tile(np.array(ids), len(part)),
                        "dist": found.ravel(),
                    }
                )

    return distances


def anchor_histogram(vectors: DataFrame, anchors: DataFrame, bins: int = 20) -> DataFrame:
    """(anchor_id, bin, low, high, rows): how far the rows are from each given profile.

    Bins split 0 to 1 evenly; 1 belongs to the last, and bins without a row are left out.
    Linear in the rows: equal profiles are merged first and counted by their number.
    """
    # The number of equal rows stands in the place of their id.
    profiles = vectors.groupBy("x").agg(F.count(F.lit(1)).alias("client_id"))
    found = anchor_distances(profiles, anchors)
    slot = F.least(F.floor(F.round("dist", 12) * bins), F.lit(bins - 1)).cast("int")
    counted = found.groupBy("anchor_id", slot.alias("bin")).agg(F.sum("client_id").alias("rows"))
    return counted.select(
        "anchor_id",
        "bin",
        (F.col("bin") / bins).alias("low"),
        ((F.col("bin") + 1) / bins).alias("high"),
        "rows",
    )


def profile_classes(vectors: DataFrame) -> DataFrame:
    """(client_id, class_id): rows with equal profiles share the smallest of their ids."""
    named = vectors.groupBy("x").agg(F.min("client_id").alias("class_id"))
    return vectors.join(named, "x").select("client_id", "class_id")


def similar_profiles(vectors: DataFrame, most: float) -> DataFrame:
    """(a, b, rows_a, rows_b, dist): all pairs of different profiles at a distance of at most ``most``.

    Profiles go by the smallest id of their class (``profile_classes``), and a < b. The distance
    must be above 0 and below 1; entries must not be negative. Exact, by prefix filter (Chaudhuri
    et al. 2006): with the rarest activities first, two profiles that near share an activity among
    the first ones that hold more than a share ``most`` of a profile's sum. Only profiles that
    share one of these, and whose sums are near enough, are compared. A combination of an activity
    and a size that many profiles have is dealt in parts of ``PART_ROWS``, and every two parts
    meet once, so neither a task nor the driver holds all its profiles. Two parts are compared by
    one call on their matrices. Rows without any care are one class, far from all others.
    """
    if not 0 < most < 1:
        raise ValueError("the distance must lie between 0 and 1")
    least = 1.0 - most
    classes = vectors.groupBy("x").agg(F.min("client_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes, "profile-classes")
    first = classes.select(F.size("x")).first()
    dims = first[0] if first else 0
    zero = F.lit(0.0)
    # One number per activity: how many profiles have it.
    counts = classes.agg(*[F.count_if(F.col("x")[i] > 0) for i in range(dims)]).first() if dims else []
    order = sorted(range(dims), key=lambda i: (counts[i], i))
    ordered = F.array(*[F.col("x")[i] for i in order]) if dims else F.array().cast("array<double>")
    total = F.aggregate("x", zero, lambda s, v: s + v)
    # Rounded up by a hair, so that no profile misses a place by rounding.
    share = F.col("total") * (most * (1 + 1e-9))
    before = F.aggregate(
        "w",
        F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("places"), F.lit(0).alias("i")),
        lambda s, w: F.struct(
            (s["sum"] + w).alias("sum"),
            F.when((w > 0) & (s["sum"] <= share), F.concat(s["places"], F.array(s["i"])))
            .otherwise(s["places"])
            .alias("places"),
            (s["i"] + 1).alias("i"),
        ),
    )
    step = -math.log(least) * (1 + 1e-9)
    held = classes.withColumns({"total": total, "w": ordered}).filter("total > 0")
    held = held.select(
        "id", "rows", "x", "total", before["places"].alias("places"),
        F.floor(F.ln("total") / F.lit(step)).alias("size"),
    )
    held = materialise(held, "profile-prefixes")

    keys = ["place", "at"]
    posts = held.select(F.explode("places").alias("place"), F.col("size").alias("at")).groupBy(*keys).count()
    # Few: each has more than a part of the profiles, and all others have one part.
    many = posts.filter(F.col("count") > PART_ROWS)
    many = many.select(*keys, F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    many = measured(materialise(many, "frequent-prefixes"), keys)

    def posted(sizes: Column, name: str, other: str, mine: str) -> DataFrame:
        spread = held.withColumn("place", F.explode("places")).withColumn("at", F.explode(sizes))
        spread = many.join(spread, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        spread = spread.withColumn(mine, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        spread = spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # All profiles of a part in one row.
        dealt = spread.select(*cell, F.struct(*columns).alias("held")).repartition(cells, *cell)
        return dealt.groupBy(*cell).agg(F.collect_list("held").alias(name))

    cell = [*keys, "part_1", "part_2"]
    columns = ("id", "rows", "x", "total", "places")
    # Pairs, not bytes, are the work of a task, so the number of tasks is given.
    cells = _partitions(classes, -(-classes.count() // PART_ROWS))
    index = posted(F.array("size"), "held_2", "part_1", "part_2")
    asked = posted(F.array("size", F.col("size") + 1), "held_1", "part_2", "part_1")
    # The size of exploded rows is not known to the planner: it would send them to all tasks.
    both = asked.join(index.hint("merge"), cell).select("place", "held_1", "held_2")
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("id", "rows", "total")}
    schema = ", ".join(f"{c}_{side} {kind}" for side in (1, 2) for c, kind in kinds.items())
    found = both.mapInArrow(_near_pairs(dims, most), schema + ", dist double")
    found = found.filter(F.struct("total_1", "id_1") < F.struct("total_2", "id_2"))
    swapped = F.col("id_1") > F.col("id_2")
    either = lambda one, two: F.when(swapped, F.col(two)).otherwise(F.col(one))
    return found.select(
        either("id_1", "id_2").alias("a"),
        either("id_2", "id_1").alias("b"),
        either("rows_1", "rows_2").alias("rows_a"),
        either("rows_2", "rows_1").alias("rows_b"),
        "dist",
    )


def _near_pairs(dims: int, most: float) -> Callable:
    """Pairs of each two lists of profiles that are near, the one of smaller (or equal) sum first.

    A pair that shares more than one place of its prefixes is given at the first of them only.
    """
    least, slice_rows = (1.0 - most) * (1 - 1e-9), SLICE_ROWS

    def laid_out(profiles: pa.StructArray) -> tuple:
        total = profiles.field("total").to_numpy(zero_copy_only=False)
        profiles = profiles.take(pa.array(np.argsort(total, kind="stable")))
        count = len(profiles)
        x = profiles.field("x").flatten().to_numpy(zero_copy_only=False).reshape(count, dims)
        places = profiles.field("places")
        held = np.zeros((count, dims), bool)
        held[np.repeat(np.arange(count), places.value_lengths()), places.flatten()] = True
        return profiles, np.ascontiguousarray(x.T), profiles.field("total").to_numpy(zero_copy_only=False), held

    def near(place: int, one: tuple, two: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        (_, x_1, total_1, held_1), (_, x_2, total_2, held_2) = one, two
        for start in range(0, len(total_1), slice_rows):
            total = total_1[start : start + slice_rows, None]
            # Sums are in order: only those within the distance of the slice are looked at.
            begin = np.searchsorted(total_2, total[0, 0])
            end = np.searchsorted(total_2 * least, total[-1, 0], "right")
            others = total_2[begin:end]
            low = np.zeros((len(total), len(others)))
            for p, q in zip(x_1[:, start : start + slice_rows], x_2[:, begin:end]):
                low += np.minimum.outer(p, q)
            with np.errstate(invalid="ignore"):
                dist = 1 - low / (total + others - low)
            i, j = np.nonzero((dist <= most + 1e-12) & (total <= others) & (total >= others * least))
            dist = dist[i, j]
            i, j = i + start, j + begin
            first = ~(held_1[i, :place] & held_2[j, :place]).any(axis=1)
            yield i[first], j[first], dist[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column("held_1"), batch.column("held_2")]
            for row, place in enumerate(batch.column("place").to_pylist()):
                # Slices of the values of both lists of the row.
                one, two = (laid_out(c.slice(row, 1).flatten()) for c in lists)
                for i, j, dist in near(place, one, two):
                    if len(i):
                        columns = [
                            side[0].field(name).take(pa.array(at))
                            for side, at in ((one, i), (two, j))
                            for name in ("id", "rows", "total")
                        ]
                        names = [f"{name}_{side}" for side in (1, 2) for name in ("id", "rows", "total")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(dist)], names=[*names, "dist"])

    return run


def _partitions(df: DataFrame, blocks: int) -> int:
    """Partitions for the pairs of some blocks: about two a pair, and enough for every core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return min(CELLS, max(2 * cores, blocks * (blocks + 1)))


def in_blocks(
    df: DataFrame,
    key: str,
    compare: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    both_sides: bool = False,
) -> DataFrame:
    """Apply ``compare`` to every pair of row blocks.

    Rows are dealt to blocks of at most about ``block_rows`` by a hash of the
    unique ``key``, so a task holds two blocks whatever the data look like; small
    tables get enough blocks to use every core. With n rows this is n²/2
    comparisons (n² with ``both_sides``), and every row is shuffled once per
    block; meant for statistics over all pairs, not for the clustering path. Pairs of
    blocks are dealt to a given number of tasks: their work is not in proportion to bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Several pairs a core, so that tasks with one more or less end at about the same time.
    blocks = max(math.ceil(df.count() / block_rows), math.ceil(math.sqrt((2 if both_sides else 4) * cores)))
    own = df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    last = F.lit(blocks - 1)
    first_of_left = F.lit(0) if both_sides else F.col("_own")
    last_of_right = last if both_sides else F.col("_own")
    left = own.withColumn("_other", F.explode(F.sequence(first_of_left, last))).select(
        "*", F.col("_own").alias("_i"), F.col("_other").alias("_j")
    )
    # Columns of their own on the right: both sides come from one table.
    copied = own.select(*[F.col(c).alias(c) for c in own.columns])
    right = copied.withColumn("_other", F.explode(F.sequence(F.lit(0), last_of_right))).select(
        "*", F.col("_other").alias("_i"), F.col("_own").alias("_j")
    )
    cells = _partitions(df, blocks)
    left, right = (side.repartition(cells, "_i", "_j").groupBy("_i", "_j") for side in (left, right))
    return left.cogroup(right).applyInPandas(compare, schema)


def distance_histogram(
    vectors: DataFrame, bins: int = 20, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(bin, low, high, pairs): how the distances of all pairs are distributed.

    Bins split 0 to 1 evenly; 1 belongs to the last. Equal profiles are merged
    first and counted by multiplicity, so copies cost nothing. Exact; quadratic
    in the number of different profiles.
    """
    profiles = vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    measure, slice_rows = _weighted_jaccard(), SLICE_ROWS

    def count_bins(key, left, right):
        import numpy as np
        import pandas as pd

        held = np.zeros(bins)
        for start in range(0, len(left) if len(right) else 0, slice_rows):
            part = left.iloc[start : start + slice_rows]
            found = measure(np.stack(part["x"].to_numpy()), np.stack(right["x"].to_numpy()))
            slot = np.minimum(np.floor(np.round(found, 12) * bins), bins - 1).astype(int)
            a, b = part["copies"].to_numpy(float), right["copies"].to_numpy(float)
            pairs = np.multiply.outer(a, b)
            if key[0] == key[1]:
                # Same block on both sides, maybe in another order: count halves.
                same = np.equal.outer(part["_row"].to_numpy(), right["_row"].to_numpy())
                pairs = np.where(same, np.multiply.outer(a, b - 1), pairs) / 2
                slot = np.where(same, 0, slot)
            held += np.bincount(slot.ravel(), weights=pairs.ravel(), minlength=bins)
        return pd.DataFrame({"bin": np.arange(bins), "pairs": held.round().astype("int64")})

    rows = materialise(profiles.withColumn("_row", F.md5(F.col("x").cast("string"))), "profiles")
    counted = in_blocks(rows, "_row", count_bins, "bin int, pairs long", block_rows)
    return counted.groupBy("bin").agg(F.sum("pairs").alias("pairs")).select(
        "bin",
        (F.col("bin") / bins).alias("low"),
        ((F.col("bin") + 1) / bins).alias("high"),
        "pairs",
    )
