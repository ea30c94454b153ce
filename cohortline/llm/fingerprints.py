"""Document fingerprints from prefix polynomial hashes.

The hashes of all prefixes of a text, modulo two primes, answer whether any two spans are
equal in constant time, and the longest common extension of two positions by binary search.
The fingerprint of a text is the hash of the whole and, for each of ``SLOTS`` classes of
spans of ``SPAN`` code points, the smallest span hash, of which eight bits are kept. The
share of equal slots tells how much of two texts is common, wherever it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortline.llm.common import id_and_text

#: Two primes below 2**31 and a base for each (fixed, so fingerprints stay comparable).
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, SLOTS = 12, 128
#: Text bytes that one task walks through in order, about.
PART_BYTES = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    prime = PRIMES[which]
    if which not in _powers:
        _powers[which] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    while len(_powers[which][0]) < n:
        size = len(_powers[which][0])
        grown = []
        for table, base in zip(_powers[which], (BASES[which], pow(BASES[which], -1, prime))):
            grown.append(np.r_[table, table * np.uint64(pow(base, size, prime)) % np.uint64(prime)])
        _powers[which] = tuple(grown)
    return _powers[which]


@dataclass
class Prefixes:
    """Prefix hashes of a text: ``sums[m][i]`` covers the first i code points."""

    length: int
    sums: list[np.ndarray]

    @classmethod
    def of(cls, text: str) -> Prefixes:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sums = []
        for which, prime in enumerate(PRIMES):
            power, _ = _power_tables(which, len(points) + 1)
            terms = (points + np.uint64(1)) * power[: len(points)] % np.uint64(prime)
            # Up to 2**32 terms below 2**31 each: the sum fits.
            sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(terms)] % np.uint64(prime))
        return cls(len(points), sums)

    def span(self, first, size):
        """Hash of the span(s) of ``size`` code points from ``first`` (62 bits)."""
        out = []
        for which, prime in enumerate(PRIMES):
            _, inverse = _power_tables(which, self.length + 1)
            sums, p = self.sums[which], np.uint64(prime)
            out.append((sums[first + size] + p - sums[first]) % p * inverse[first] % p)
        return out[0] << np.uint64(31) | out[1]

    def spans(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` code points, in order."""
        if size > self.length:
            return np.zeros(0, np.uint64)
        return self.span(np.arange(self.length - size + 1), size)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span that starts at ``i`` in a and at ``j`` in b."""
    low, high = 0, min(a.length - i, b.length - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


EMPTY = ~np.uint64(0)


def slot_minima(spans: np.ndarray) -> np.ndarray:
    """The smallest mixed span hash of each slot (``EMPTY`` where there is none)."""
    low = np.full(SLOTS, EMPTY)
    mixed = spans * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    np.minimum.at(low, (mixed & np.uint64(SLOTS - 1)).astype(np.int64), mixed >> np.uint64(8))
    return low


def fingerprint(whole: int, length: int, low: np.ndarray) -> str:
    """Hex: hash of the whole text, its length, which slots are used, and eight bits of each."""
    used = np.packbits(low != EMPTY).tobytes()
    return f"{whole:016x}{length:08x}" + used.hex() + (low & np.uint64(255)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Dice), from two fingerprints alone; 1 if they are equal.

    A text without spans of its own is like an equal text only.
    """
    if a == b:
        return 1.0
    cut = 24 + SLOTS // 4
    used = [np.unpackbits(np.frombuffer(bytes.fromhex(x[24:cut]), np.uint8)) > 0 for x in (a, b)]
    bits = [np.frombuffer(bytes.fromhex(x[cut:]), np.uint8) for x in (a, b)]
    either, both = (used[0] | used[1]).sum(), used[0] & used[1]
    if not either:
        return 0.0
    equal = (both & (bits[0] == bits[1])).sum()
    # One in 256 of the other slots agrees by chance.
    share = max(0.0, (equal - (both.sum() - equal) / 255) / either)
    return float(2 * share / (1 + share))


def _whole(prefixes: Prefixes) -> int:
    return int(prefixes.span(0, prefixes.length))


@dataclass
class Document:
    text: str
    prefixes: Prefixes
    spans: np.ndarray

    @classmethod
    def of(cls, text: str) -> Document:
        prefixes = Prefixes.of(text)
        return cls(text, prefixes, prefixes.spans(SPAN) if len(text) >= SPAN else _short(prefixes))

    def fingerprint(self) -> str:
        return fingerprint(_whole(self.prefixes), len(self.text), slot_minima(self.spans))


def _short(prefixes: Prefixes) -> np.ndarray:
    """A text shorter than a span is one span; an empty one has none."""
    return np.array([_whole(prefixes)], np.uint64) if prefixes.length else np.zeros(0, np.uint64)


def edited(own: Document, following: Document) -> tuple[str, str]:
    """The edited text and its fingerprint.

    Spans inside the part kept and inside the part taken over have the hashes they have
    in their own texts; only those across the seam are hashed anew.
    """
    size = min(len(own.text) // 3, len(following.text))
    cut = len(own.text) - len(own.text) // 3
    text = own.text[:cut] + following.text[:size]
    prefixes = Prefixes.of(text)
    if len(text) < SPAN:
        return text, fingerprint(_whole(prefixes), len(text), slot_minima(_short(prefixes)))
    seam = np.arange(max(0, cut - SPAN + 1), min(cut, len(text) - SPAN + 1))
    low = slot_minima(prefixes.span(seam, SPAN))
    if cut >= SPAN:
        low = np.minimum(low, slot_minima(own.spans[: cut - SPAN + 1]))
    if size >= SPAN:
        low = np.minimum(low, slot_minima(following.spans[: size - SPAN + 1]))
    return text, fingerprint(_whole(prefixes), len(text), low)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the text that follows it; borrowed rows only end a part."""
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    held: tuple | None = None
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")]
        for part, borrowed, doc_id, text in zip(*columns):
            following = Document.of(text)
            if held is not None and held[0] == part and not held[1]:
                rows.append(_result(held[2], held[3], following))
            held = (part, borrowed, doc_id, following)
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row)) for row in rows], schema=_arrow_schema(names)
        )


def _arrow_schema(names: list[str]) -> pa.Schema:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "common_prefix": pa.int64()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def _result(doc_id: int, own: Document, following: Document) -> tuple:
    text, changed = edited(own, following)
    mine = own.fingerprint()
    digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
    near, next_near = likeness(mine, changed), likeness(mine, following.fingerprint())
    shared = common_extension(own.prefixes, 0, following.prefixes, 0)
    return doc_id, len(own.text), digest, mine, changed, near, next_near, shared


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, common_prefix long"
)


def fingerprint_documents(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``, with the columns of ``SCHEMA``.

    "Next" follows by descending id (rows without an id last, equal ids by a hash of the
    text), and the first row follows the last; a single row follows itself. Null texts
    are empty. ``common_prefix`` is the longest common extension of a text and the next.

    Ids are cut into ranges of about equal row counts; a task walks one range in order. The first row of a
    range is also lent to the range before it, so no task needs another's rows. Only the
    range limits and one id per range reach the driver.
    """
    read = id_and_text(docs)
    size = read.agg(
        F.sum(F.octet_length("text")).alias("b"), F.count_if(F.col("doc_id").isNull()).alias("none")
    ).first()
    parts = max(1, -(-(size["b"] or 0) // part_bytes))
    cuts = []
    if parts > 1:
        shares = F.lit([i / parts for i in range(1, parts)])
        found = read.agg(F.percentile_approx("doc_id", shares, 10 * parts).alias("c")).first()["c"]
        cuts = sorted(set(found or []))
    # The first row of each part: of the ids alone, and of rows without one by their hash.
    ids = read.filter("doc_id is not null").select("doc_id", F.lit(0).cast("long").alias("tie"))
    leads = _placed(ids, cuts, parts).groupBy("part").agg(F.max("doc_id").alias("lead"))
    leads = [(False, r["lead"], r["part"]) for r in leads.orderBy("part").collect()]
    tie = F.xxhash64("text").alias("tie")
    if size["none"]:
        rest = read.filter("doc_id is null").select("doc_id", tie)
        rest = _placed(rest, cuts, parts).groupBy("part").agg(F.min("tie").alias("lead"))
        leads += [(True, r["lead"], r["part"]) for r in rest.orderBy("part").collect()]
    lent = [(none, lead, leads[i - 1][2]) for i, (none, lead, _) in enumerate(leads)]
    borrow = docs.sparkSession.createDataFrame(lent, "none boolean, lead long, borrower int")
    rows = _placed(read.select("doc_id", tie, "text"), cuts, parts)
    rows = rows.withColumns(
        {"none": F.col("doc_id").isNull(), "lead": F.coalesce("doc_id", "tie"), "borrowed": F.lit(False)}
    )
    first = rows.join(F.broadcast(borrow), ["none", "lead"])
    first = first.withColumns({"part": F.col("borrower"), "borrowed": F.lit(True)})
    both = rows.unionByName(first.drop("borrower"))
    ordered = both.repartition("part").sortWithinPartitions(
        "part", "borrowed", "none", F.desc("doc_id"), "tie"
    )
    return ordered.select("part", "borrowed", "doc_id", "text").mapInArrow(_walk, SCHEMA)


def _placed(rows: DataFrame, cuts: list[int], parts: int) -> DataFrame:
    """``rows`` with their part: 0 has the highest ids; rows without an id follow by hash."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("doc_id"), batch.column("tie").to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            part = len(sent.value) - np.searchsorted(sent.value, numbers, side="left")
            share = ((ties >> 32) + (1 << 31)) * parts >> 32
            part = np.where(known, part, len(sent.value) + 1 + share)
            yield batch.append_column("part", pa.array(part.astype(np.int32)))

    schema = StructType([*rows.schema, StructField("part", IntegerType())])
    return rows.mapInArrow(run, schema)
