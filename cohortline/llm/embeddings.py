"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A table of the index rotates a vector by sign flips and Walsh-Hadamard transforms and takes
the axis (with its sign) the result is closest to; ``HASHES`` such axes make a bucket. Each
vector is posted to its bucket and to the next most likely one (multiprobe), in ``TABLES``
tables. Every pair that shares a bucket is verified by its cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import local_roots
from cohortline.llm.components import connected_components

COSINE, TABLES, HASHES, PROBES, SEED = 0.93, 5, 2, 2, 7
#: Vectors of a bucket compared in one task; larger buckets become several tiles.
TILE = 2000
#: Numbers in the vectors of one group of tiles, about; tiles of up to so many rows are compared
#: together; numbers or links held at once.
GROUP_NUMBERS, WHOLE, WORKED = 2_000_000, 64, 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long)."""
    size = 1
    while size < x.shape[1]:
        y = x.reshape(len(x), -1, 2, size)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        size *= 2
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(unit: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Buckets of each row: ``tables * probes`` numbers, different for different tables."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    random = np.random.default_rng(SEED)
    rows, out = np.arange(len(unit)), []
    for table in range(tables):
        axes, seconds, losses = [], [], []
        for _ in range(hashes):
            turned = padded
            for signs in random.choice([-1.0, 1.0], size=(3, width)):
                turned = hadamard(turned * signs) / np.sqrt(width)
            size = np.abs(turned)
            best = size.argmax(axis=1)
            top = size[rows, best]
            size[rows, best] = -1
            next_best = size.argmax(axis=1)
            losses.append(top - size[rows, next_best])
            axes.append(2 * best + (turned[rows, best] < 0))
            seconds.append(2 * next_best + (turned[rows, next_best] < 0))
        axes, seconds = np.array(axes), np.array(seconds)
        cheapest = np.argsort(np.array(losses), axis=0, kind="stable")
        for probe in range(probes):
            chosen = axes.copy()
            if probe:
                # The axis with the least loss moves to its second best, then the next one.
                which = cheapest[(probe - 1) % hashes]
                chosen[which, rows] = seconds[which, rows]
            code = np.full(len(unit), table, np.int64)
            for part in chosen:
                code = code * (2 * width) + part
            out.append(code)
    return np.stack(out, axis=1)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), length)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [b""] * batch.num_rows
        for rows, matrix in _by_length(batch.column("vector")):
            for row, vector in zip(rows, matrix + 0.0):  # one zero, not two
                keys[row] = hashlib.md5(vector.tobytes()).digest()
        columns = [batch.column(c) for c in ("vec_id", "label", "vector")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(keys, pa.binary())], names=["vec_id", "label", "vector", "key"]
        )


def _post(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [None] * batch.num_rows
            for rows, matrix in _by_length(batch.column("vector")):
                found = bucket_codes(unit_rows(matrix), tables, hashes, probes)
                for row, code in zip(rows, found.tolist()):
                    codes[row] = code
            columns = [batch.column(c) for c in ("label", "rep", "copies", "vector")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(codes, pa.list_(pa.int64()))],
                names=["label", "rep", "copies", "vector", "codes"],
            )

    return run


def _close_pairs(unit: np.ndarray, run: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run at the least cosine; ``run`` numbers consecutive equal rows."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    for start, size in zip(starts[sizes > WHOLE], sizes[sizes > WHOLE]):
        part = unit[start : start + size]
        for first in range(0, size, 256):
            near = part[first : first + 256] @ part.T >= cosine
            near &= np.arange(first, first + len(near))[:, None] < np.arange(size)[None, :]
            a, b = np.nonzero(near)
            yield start + first + a, start + b
    # Small runs are taken all together: each row with the next one of its run, the one after, ...
    low = np.flatnonzero(np.repeat(sizes <= WHOLE, sizes))
    block = max(1, WORKED // max(1, unit.shape[1]))
    for step in range(1, min(WHOLE, len(run))):
        low = low[: np.searchsorted(low, len(run) - step)]
        low = low[run[low] == run[low + step]]
        for first in range(0, len(low), block):
            a = low[first : first + block]
            a = a[np.einsum("ij,ij->i", unit[a], unit[a + step]) >= cosine]
            yield a, a + step


def _compare(cosine: float, table: pa.Table) -> pa.Table:
    """Links of some tiles: how many copies each vector links to here, and its local root.

    A pair that meets in several buckets counts in the first of them only, which its two
    lists of buckets tell. In a tile of two different parts, only pairs across count.
    """
    table = table.combine_chunks()
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    place = [table.column(c).to_numpy() for c in ("high", "low", "bucket")]
    rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
    bucket, cross = place[-1], place[0] != place[1]
    codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for rows, matrix in _by_length(table.column("vector").combine_chunks()):
        order = np.lexsort([c[rows] for c in (*place, label)])
        rows, unit = rows[order], unit_rows(matrix[order])
        cut = np.zeros(len(rows), bool)
        for c in (*place, label):
            cut[1:] |= c[rows[1:]] != c[rows[:-1]]
        ends, held = [[], []], 0
        for a, b in _close_pairs(unit, np.cumsum(cut), cosine):
            a, b = rows[a], rows[b]
            apart = ~cross[a] | (side[a] != side[b])
            a, b = a[apart], b[apart]
            common = np.full(len(a), np.iinfo(np.int64).max)
            for column in range(codes.shape[1]):
                meets = (codes[b] == codes[a, column][:, None]).any(axis=1)
                common[meets] = np.minimum(common[meets], codes[a[meets], column])
            first = common == bucket[a]
            ends[0].append(a[first])
            ends[1].append(b[first])
            held += first.sum()
            if held >= WORKED:
                root = _joined(ends, links, root, copies)
                ends, held = [[], []], 0
        if held:
            root = _joined(ends, links, root, copies)
    has = np.flatnonzero(links)
    return pa.table({"node": rep[has], "root": rep[root[has]], "links": links[has]})


def _joined(ends: list, links: np.ndarray, root: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Roots after links between the rows of ``ends``, whose copies are added to ``links``."""
    a, b = map(np.concatenate, ends)
    links += np.bincount(a, copies[b], len(links)).astype(np.int64)
    links += np.bincount(b, copies[a], len(links)).astype(np.int64)
    return local_roots(len(root), np.r_[a, np.arange(len(root))], np.r_[b, root])


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    tile: int = TILE,
    group_numbers: int = GROUP_NUMBERS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Only vectors of one label and one length are compared. A null label, a null or zero
    vector, or one with a null or non-finite component has no links and is its own
    component, as is a row without an id (which then has a null component). Equal vectors
    of a label are merged before the search and count as links of each other. Rows that
    share an id count as copies of one vector if they are equal; if they differ, their links
    are added up under the id. No rows give no rows.

    ``tables``, ``hashes`` and ``probes`` set the recall (tests hold it to brute force). All vectors are indexed. A
    bucket of more than ``tile`` vectors is compared in tiles by several tasks, none left out.
    Tiles are dealt by hash to groups of about ``group_numbers`` numbers, each compared by one call.
    """
    value = F.col("embedding")
    kind = dict(vectors.select("embedding").dtypes)["embedding"]
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(value, lambda x: x != 0)
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    good = read.filter(valid).select("vec_id", "label", F.col("embedding").alias("vector"))
    keyed = good.mapInArrow(_keys, f"vec_id long, label string, vector {kind}, key binary")
    keyed = materialise(keyed, "vectors")
    classes = keyed.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = materialise(classes, "vector-classes")
    one = keyed.join(
        classes, (keyed["vec_id"] == classes["rep"]) & (keyed["key"] == classes["key"]) & (keyed["label"] == classes["label"])
    ).select(classes["label"], "rep", "copies", "vector", classes["key"]).dropDuplicates(["label", "key"])
    schema = f"label string, rep long, copies long, vector {kind}, codes array<long>"
    posted = one.drop("key").mapInArrow(_post(tables, hashes, probes), schema)
    posted = materialise(posted, "posted").withColumn("dims", F.size("vector"))
    place = ["label", "dims", "bucket"]
    sizes = posted.select("label", "dims", F.explode(F.array_distinct("codes")).alias("bucket")).groupBy(*place).count()
    sizes = materialise(sizes.filter("count > 1"), "buckets")
    spread = posted.withColumn("bucket", F.explode(F.array_distinct("codes")))
    # A bucket of p parts has a tile for each pair of parts; a row goes to the p tiles of its part.
    parts = sizes.select(*place, F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    if parts.count() <= 500_000:
        parts = F.broadcast(parts)
    spread = spread.join(parts, place)
    spread = spread.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    tiled = spread.withColumns({"low": low, "high": high})
    # Most buckets hold a few vectors: many tiles are compared by one call.
    numbers = sizes.agg(F.sum(F.col("count") * F.ceil(F.col("count") / tile) * F.col("dims"))).first()[0] or 0
    groups = F.pmod(F.xxhash64(*place, "low", "high"), F.lit(max(1, -(-numbers // group_numbers))))
    dealt = tiled.withColumn("dealt", groups).drop("dims", "parts", "other", "cross").groupBy("dealt")
    found = dealt.applyInArrow(lambda table: _compare(cosine, table), "node long, root long, links long")
    found = materialise(found, "vector-links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_rep = links.join(roots, "node", "left")
    own = keyed.select("vec_id", "label", "key").distinct().join(classes, ["label", "key"])
    own = own.join(by_rep, F.col("rep") == F.col("node"), "left")
    total = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    own = own.groupBy(F.col("vec_id").alias("id")).agg(
        F.sum(total).alias("n"), F.min(F.coalesce("root", "rep")).alias("lowest")
    )
    component = F.coalesce("lowest", "vec_id")
    return read.select("vec_id").join(own, read["vec_id"] == F.col("id"), "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
