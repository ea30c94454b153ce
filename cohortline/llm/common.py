"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortline.core.workspace import materialise

#: A side of a join is broadcast up to this many rows of fixed width, else shuffled.
BROADCAST_ROWS = 1_000_000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text counts as empty."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), text.alias("text"))


def text_key(text: Column) -> Column:
    """SHA-256 of a text, null as empty: what rows of one text have in common."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def join_small(
    big: DataFrame, side: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a stored ``side``: broadcast if its counted rows are within the bound ``most``.

    Beyond the bound it is a shuffle join whose frequent keys adaptive execution splits.
    """
    if side.count() <= most:
        return big.join(F.broadcast(side), key, how)
    return big.join(side, key, how)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that results of long texts don't pile up.

    Freed memory of batches is given back at the end: workers stay for other tasks.
    """
    batch = None
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    del batch
    pa.default_memory_pool().release_unused()


class Cache(dict):
    """``compute(key)`` for every key asked for, with two bounded generations.

    When the young generation is full it becomes the old one, so keys in use move on and
    keys seen once are forgotten. The bound only decides what is computed again.
    """

    def __init__(self, compute: Callable, bound: int = 400_000):
        super().__init__()
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def majority_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each consecutive run of ``hashes``.

    ``counts`` has the length of each run; a run of length 0 gives 0. A bit is 1 if more
    than half of the run's hashes have it.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    lengths = counts[full].astype(np.int64)
    bits = np.unpackbits(
        np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    # Eight bit counts side by side in one integer: up to 255 rows can be added at once.
    parts = -(-lengths // 255)
    first_part = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first_part, parts)
    starts = np.repeat(np.cumsum(lengths) - lengths, parts) + 255 * within
    sums = np.add.reduceat(bits.view(np.uint64), starts, axis=0).view(np.uint8)
    totals = np.add.reduceat(sums.astype(np.int64), first_part, axis=0)
    set_bits = (2 * totals > lengths[:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indexes over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Stored ``df`` with ``number``: its rows counted from 0 in the order of ``key``.

    Rows are laid out by range and sorted inside each, and only one count per range is
    gathered, so no task sees all rows. Rows of one key come in any order.
    """
    laid = df.repartitionByRange(quoted(key)).sortWithinPartitions(quoted(key))
    # The id is the range in the upper bits and the place in it in the 33 lower ones.
    laid = materialise(laid.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumn("_range", F.shiftright("_id", 33))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_first")
    )
    number = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(ranges), "_range").withColumn("number", number).drop(
        "_range", "_id", "_first"
    )
