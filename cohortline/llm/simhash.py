"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints of a group are sorted by Gray rank, so neighbours share many bits. Runs of
them form nodes; a node keeps the bits all its members share (mask and pattern), and a
child keeps only the shared bits its parent does not have yet. A search walks down from
the top, adds up the differing bits level by level, and drops a whole node as soon as the
sum exceeds the bound. Groups come from ``hamming.routed``, so no task holds all
fingerprints, and only one row per distinct fingerprint enters the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import (
    id_and_text,
    join_small,
    local_roots,
    majority_fingerprints,
    quoted,
)
from cohortline.llm.components import connected_components
from cohortline.llm.hamming import block_ranges, in_groups, routed

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
FAN = 8
#: Hashes that are turned into bits at once, and queries that walk the index at once.
CHUNK, QUERIES = 200_000, 4096


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words; only A-Z are lower-cased, as ASCII bytes."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) < words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    runs = zip(*(found[i:] for i in range(words)))
    return list(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)))


def fingerprint_texts(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text, in chunks so that memory does not follow the batch."""
    out, held, counts = [], [], []

    def flush():
        hashes = np.array(held, np.uint64)
        out.append(majority_fingerprints(hashes, np.array(counts, np.int64)))
        held.clear()
        counts.clear()

    for text in texts:
        hashes = shingle_hashes(text, words)
        held.extend(hashes)
        counts.append(len(hashes))
        if len(held) >= CHUNK:
            flush()
    flush()
    return np.concatenate(out)


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, signed 64-bit ``code`` and ``row`` (hash of id and text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = fingerprint_texts(batch.column("text").to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(codes), batch.column("row")],
                names=["doc_id", "code", "row"],
            )

    read = id_and_text(docs, id_col, text_col)
    read = read.withColumn("row", F.xxhash64("doc_id", "text"))
    return read.mapInArrow(run, "doc_id long, code long, row long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy of shared bit patterns over codes sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes, self.fan = codes, fan
        ones = np.full(len(codes), ~np.uint64(0))
        levels = [(ones, codes)]
        while len(levels[-1][0]) > fan:
            mask, pattern = levels[-1]
            starts = np.arange(0, len(mask), fan)
            lead = np.repeat(pattern[starts], fan)[: len(mask)]
            shared = np.bitwise_and.reduceat(mask, starts)
            shared &= ~np.bitwise_or.reduceat(pattern ^ lead, starts)
            levels.append((shared, pattern[starts] & shared))
        self.levels = []
        for depth, (mask, pattern) in enumerate(levels):
            above = np.uint64(0)
            if depth + 1 < len(levels):
                above = np.repeat(levels[depth + 1][0], fan)[: len(mask)]
            self.levels.append((mask & ~above, pattern))
        self.levels.reverse()

    def near_pairs(self, d: int, same: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j within ``d`` bits that agree in all bits of ``same``."""
        n, must = len(self.codes), np.uint64(same)
        sizes = [len(mask) for mask, _ in self.levels]
        for first in range(0, n, QUERIES):
            asked = np.arange(first, min(n, first + QUERIES))
            query = np.repeat(asked, sizes[0])
            node = np.tile(np.arange(sizes[0]), len(asked))
            total = np.zeros(len(query), np.uint8)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    query, total = np.repeat(query, self.fan), np.repeat(total, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    real = node < sizes[depth]
                    query, node, total = query[real], node[real], total[real]
                differ = (self.codes[query] ^ pattern[node]) & mask[node]
                total = total + np.bitwise_count(differ)
                span = self.fan ** (len(self.levels) - 1 - depth)
                keep = (total <= d) & (differ & must == 0) & ((node + 1) * span - 1 > query)
                query, node, total = query[keep], node[keep], total[keep]
            yield query, node


def _links(d: int, block: int, table: pa.Table) -> pa.Table:
    """Links that join the same codes as all pairs of the group within ``d`` bits do."""
    codes = table.column("code").to_numpy().view(np.uint64)
    first, width = block_ranges(d)[block]
    # Turn the block to the top: the index then splits on it first.
    turn, back = np.uint64((64 - first - width) % 64), np.uint64((first + width) % 64)
    turned = (codes << turn) | (codes >> back) if turn else codes
    order = np.argsort(gray_rank(turned))
    codes, turned = codes[order].view(np.int64), turned[order]
    same = ((1 << width) - 1) << (64 - width)
    every = np.arange(len(codes))
    root = every
    for a, b in GrayIndex(turned).near_pairs(d, same):
        # Roots so far stand for their members, so links never pile up.
        root = local_roots(len(codes), np.r_[a, every], np.r_[b, root])
    moved = np.flatnonzero(root != every)
    return pa.table({"a": codes[moved], "b": codes[root[moved]]})


def _grouped(codes: DataFrame, max_bits: int) -> DataFrame:
    """The stored fingerprints with the smallest id of their group."""
    distinct = materialise(codes.groupBy("code").agg(F.min("doc_id").alias("low")), "codes")
    links = in_groups(routed(distinct, max_bits), partial(_links, max_bits), "a long, b long")
    roots = materialise(connected_components(links), "roots")
    linked = distinct.join(roots, distinct["code"] == roots["node"])
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    linked = linked.join(lowest, "root").select("code", "lowest")
    named = distinct.join(linked, "code", "left").select(
        "code", F.when(F.col("lowest").isNotNull(), F.col("lowest")).otherwise(F.col("low")).alias("component_id")
    )
    return codes.join(named, "code")


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` is 16 hex digits; rows link if they differ in at most ``max_bits``
    bits, and ``component_id`` is the smallest id reachable. A null text is empty; empty
    texts have fingerprint zero and link like any others. Repeated rows and ids keep one
    result row each. A row without an id takes the component of its fingerprint, null if
    no row of that component has an id. No rows give no rows. Other columns are not read.
    """
    codes = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    return _grouped(codes, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_group(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The row with the smallest id of each group, with all columns of ``docs``.

    Of several rows with that id one stays. Rows without an id go if their group has an
    id, and stay otherwise, since nothing names another row as theirs.
    """
    codes = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    goes = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = _grouped(codes, max_bits).filter(goes).select(F.col("row").alias("_row")).distinct()
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("_row", F.xxhash64(quoted(id_col).cast("long"), text))
    kept = join_small(marked, materialise(drop, "dropped"), "_row", "left_anti").drop("_row")
    repeated = codes.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count()
    repeated = materialise(repeated.filter("count > 1").select("_id"), "repeated")
    own = quoted(id_col).cast("long")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, own == F.col("_id")).drop("_id").dropDuplicates([id_col])
    return kept.join(repeated, own == F.col("_id"), "left_anti").unionByName(once)
