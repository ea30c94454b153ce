"""Alignment of two tokenizers' ids over the bytes of each text, by shared cuts.

Two token sequences of the same bytes share some ends. ``shared_cuts`` finds them by divide
and conquer: of an interval, the end of the first sequence nearest the middle that the second
one has too (found by bisection) cuts it, and both halves follow; an interval without a shared
end inside is a leaf group. A few hundred texts are halved together. Inside a group the tokens
overlap like two rulers: every stretch between neighbouring ends is one linked pair.

Each text keeps its distinct linked pairs and how often it holds each. How many texts hold a
pair is a count over all of them. The most frequent pairs (at most ``HEAVY``) are looked up in
arrays sent to every task; the others, each in few texts, are joined by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import id_and_text, slices
from cohortline.llm.packing import byte_letters

#: Pairs that are sent to every task, 17 bytes each.
HEAVY = 1_000_000
#: Bits of an id of the second tokenizer, and of a pair's number.
SECOND_BITS, PAIR_BITS = 24, 48
#: Texts worked on at once.
ROWS = 256

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, codes array<long>, times array<int>"
)


def byte_level_tokenizer(path: str) -> tuple[Callable, list[bytes]]:
    """Ids of texts by a byte-level BPE file, and the bytes of every id."""
    from tokenizers import Tokenizer

    from cohortline.llm.packing import tokens

    letters = byte_letters()
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if set(token) <= letters.keys():
            spelled[i] = bytes(letters[c] for c in token)
    ids = tokens(path).ids
    return lambda texts: [ids(" " + text) for text in texts], spelled


def piece_tokenizer(path: str) -> tuple[Callable, list[bytes]]:
    """Ids of texts by a sentencepiece file, which adds a space, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled.append(bytes([int(piece[3:5], 16)]))
        else:
            spelled.append(piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), spelled


@lru_cache(maxsize=2)
def tokenizer(kind: str, path: str) -> tuple[Callable, list[bytes], np.ndarray]:
    """One per worker process, kept over its tasks; with the length of every id."""
    encode, spelled = {"bytes": byte_level_tokenizer, "pieces": piece_tokenizer}[kind](path)
    return encode, spelled, np.array([len(s) for s in spelled], np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges, one after the other, and which range each is in."""
    which = np.repeat(np.arange(len(size)), size)
    return first[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which], which


def _halved(span: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Both parts of every interval, cut after so many ends of each sequence."""
    low_a, high_a, low_b, high_b = span
    return np.array([np.r_[low_a, at_a], np.r_[at_a, high_a], np.r_[low_b, at_b], np.r_[at_b, high_b]])


def shared_cuts(
    a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ends of ``a`` and of ``b`` up to each cut, in order.

    ``a`` and ``b`` are ascending ends of the tokens of several texts, laid one behind the
    other; text i has the ends up to ``upto_a[i]`` and ``upto_b[i]``, and its last ones are
    equal. The intervals of all texts are halved together, level by level.
    """
    # Tokens low..high-1 of both; the ends of the last ones are a cut already.
    span = np.array([np.r_[0, upto_a][:-1], upto_a, np.r_[0, upto_b][:-1], upto_b], np.int64)
    wide, step = span[:, :0], np.zeros(0, np.int64)
    leaves = [wide[1::2]]
    while span.shape[1] or wide.shape[1]:
        whole = (span[0] < span[1] - 1) & (span[2] < span[3] - 1)
        leaves.append(span[1::2, ~whole])
        span = span[:, whole]
        middle = (span[0] + span[1] - 1) >> 1
        place = np.searchsorted(b, a[middle])
        hit = b[place] == a[middle]
        parts = [_halved(span[:, hit], middle[hit] + 1, place[hit] + 1)]
        missed = span[:, ~hit]
        if wide.shape[1]:
            # Outwards from the middle: windows on both sides, twice as wide each time.
            low_a, high_a = wide[:2]
            middle = (low_a + high_a - 1) >> 1
            near, far = (1 << step) - 1, (2 << step) - 2
            right, left = middle + near, np.maximum(middle - far, low_a)
            right_size = np.maximum(np.minimum(middle + far, high_a - 2) - right + 1, 0)
            left_size = np.maximum(middle - near - left + 1, 0)
            tried, which = _ranges(np.r_[right, left], np.r_[right_size, left_size])
            place = np.searchsorted(b, a[tried])
            hit = b[place] == a[tried]
            tried, which, place = tried[hit], which[hit] % len(step), place[hit]
            # The nearest to the middle cuts.
            order = np.lexsort((np.abs(tried - middle[which]), which))
            cut, first = np.unique(which[order], return_index=True)
            first = order[first]
            parts.append(_halved(wide[:, cut], tried[first] + 1, place[first] + 1))
            uncut = np.ones(len(step), bool)
            uncut[cut] = False
            over = uncut & (right_size + left_size == 0)
            leaves.append(wide[1::2, over])
            uncut &= ~over
            wide, step = wide[:, uncut], step[uncut] + 1
        wide = np.concatenate([wide, missed], axis=1)
        step = np.r_[step, np.ones(missed.shape[1], np.int64)]
        span = np.concatenate(parts, axis=1)
    cuts = np.concatenate(leaves, axis=1)
    return tuple(cuts[:, np.argsort(cuts[0], kind="stable")])


@lru_cache(maxsize=2)
def spellings(size_a: int, size_b: int) -> list[str]:
    """Every id with what may follow it: ``i,`` and ``i|`` of the first, ``i,`` and ``i;`` of
    the second vocabulary."""
    marked = [(size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")]
    return [f"{i}{mark}" for size, mark in marked for i in range(size)]


def _in_groups(
    a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, sizes: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all groups in written order, as indexes of ``spellings``; and its length up to
    each group."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cuts_a - 1] = last_b[cuts_b - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.r_[0, cuts_b][:-1]
    out = np.zeros(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before_b[group_a]] = a + last_a * sizes[0]
    out[np.arange(len(b)) + cuts_a[group_b]] = 2 * sizes[0] + b + last_b * sizes[1]
    return out, cuts_a + cuts_b


def align_batch(texts: list[str], first: tuple, second: tuple) -> tuple[np.ndarray, list[str], tuple]:
    """Of every text four numbers (tokens of both, groups, links), the digest of its groups, and
    its distinct pairs: how many, their codes, and the times of each.

    A text that is empty or not given back byte by byte has zeros and no digest.
    """
    encode_a, spelled_a, sizes_a = first
    encode_b, spelled_b, sizes_b = second
    good, ids_a, ids_b = [], [], []
    for i, (text, a, b) in enumerate(zip(texts, encode_a(texts), encode_b(texts))):
        whole = (" " + text).encode("utf-8", "surrogatepass")
        if text and b"".join([spelled_a[t] for t in a]) == whole == b"".join([spelled_b[t] for t in b]):
            good.append(i)
            ids_a.append(a)
            ids_b.append(b)
    numbers = np.zeros((4, len(texts)), np.int64)
    digests = [""] * len(texts)
    if not good:
        none = np.zeros(0, np.int64)
        return numbers, digests, (numbers[0], none, none.astype(np.int32))
    upto_a, upto_b = (np.cumsum([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n[-1])) for ids, n in ((ids_a, upto_a), (ids_b, upto_b)))
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    cuts_a, cuts_b = shared_cuts(ends_a, ends_b, upto_a, upto_b)

    # A text ends with a cut; so its groups are those up to the cut of its last token.
    groups = np.searchsorted(cuts_a, upto_a) + 1
    numbers[0, good], numbers[1, good] = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    numbers[2, good] = np.diff(groups, prepend=0)
    written, lengths = _in_groups(a, b, cuts_a, cuts_b, (len(spelled_a), len(spelled_b)))
    table = spellings(len(spelled_a), len(spelled_b))
    start = 0
    for i, end in zip(good, lengths[groups - 1].tolist()):
        text = "".join([table[t] for t in written[start:end].tolist()])
        digests[i] = hashlib.sha256(text[:-1].encode()).hexdigest()
        start = end

    # Every stretch between neighbouring ends lies in one token of each: a linked pair.
    stops = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    stops = stops[np.r_[True, stops[1:] != stops[:-1]]]
    over_a, over_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
    links = np.diff(np.searchsorted(over_a, upto_a), prepend=0)
    numbers[3, good] = links
    codes = np.repeat(np.array(good, np.int64), links) << PAIR_BITS | a[over_a] << SECOND_BITS | b[over_b]
    codes.sort()
    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    times = np.diff(np.r_[new, len(codes)]).astype(np.int32)
    codes = codes[new]
    distinct = np.bincount(codes >> PAIR_BITS, minlength=len(texts))
    return numbers, digests, (distinct, codes & ((1 << PAIR_BITS) - 1), times)


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """One stored row per document, with its distinct pairs (``codes``) and their ``times``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizer("bytes", path_a), tokenizer("pieces", path_b)
        for batch in slices(batches, ROWS):
            found = align_batch(batch.column("text").to_pylist(), first, second)
            numbers, digests, (distinct, codes, times) = found
            offsets = pa.array(np.r_[0, np.cumsum(distinct)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    *map(pa.array, numbers),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(codes)),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ],
                names=[part.split()[0] for part in ALIGNED.split(", ")],
            )

    read = id_and_text(docs, id_col, text_col)
    read = read.withColumn("row", F.monotonically_increasing_id())
    return materialise(read.mapInArrow(run, ALIGNED), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """``code, held, best`` of every pair: texts that hold it, and whether that is the most
    of any pair with its first id; stored."""
    counts = texts.select(F.explode("codes").alias("code")).groupBy("code")
    counts = materialise(counts.agg(F.count(F.lit(1)).alias("held")), "pair-counts")
    first = F.shiftright("code", SECOND_BITS)
    # One row per id of the first vocabulary, whose size bounds the broadcast.
    most = counts.groupBy(first.alias("first")).agg(F.max("held").alias("most"))
    both = counts.withColumn("first", first).join(F.broadcast(most), "first")
    return materialise(both.select("code", "held", (F.col("held") == F.col("most")).alias("best")), "pairs")


def _least_heavy(counts: DataFrame, heavy: int) -> int:
    """The smallest count such that at most ``heavy`` pairs reach it."""
    by_log = counts.groupBy(F.floor(F.log2("held")).alias("log")).agg(F.count(F.lit(1)).alias("pairs"))
    total, least = 0, None
    for row in sorted(by_log.collect(), key=lambda r: -r["log"]):
        total += row["pairs"]
        if total > heavy:
            break
        least = 1 << int(row["log"])
    return least if least is not None else 1 << 62


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy: int = HEAVY,
) -> DataFrame:
    """How two tokenizers cut every document, and how usual its links are.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. ``path_a`` is a
    byte-level BPE file, read with a space before the text, ``path_b`` a sentencepiece file
    that adds one. A text that is null or empty, or that one of them does not give back byte
    by byte, has zeros and an empty ``groups_sha256``. Ids may be null or repeat: every row has
    its own result. No rows give no rows. Other columns are not read, so no names clash.

    ``heavy`` bounds the pairs sent to every task; it never changes a result.
    """
    texts = align_texts(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(texts)
    least = _least_heavy(counts, heavy)
    # At most ``heavy`` rows of three numbers.
    sent = counts.filter(F.col("held") >= least).toArrow()
    order = np.argsort(sent.column("code").to_numpy())
    arrays = tuple(sent.column(n).to_numpy()[order] for n in ("code", "held", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    names = [part.split()[0] for part in ALIGNED.split(", ")][:7]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, best = shared.value
        for batch in batches:
            lists, times = batch.column("codes"), batch.column("times").flatten().to_numpy()
            codes = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            line = np.repeat(np.arange(len(sizes)), sizes)
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            part, weight = line[hit], times[hit].astype(np.int64)
            sums = np.zeros((2, len(sizes)), np.int64)
            if len(known):
                np.add.at(sums[0], part, weight * best[place[hit]])
                np.add.at(sums[1], part, weight * held[place[hit]])
            left = np.bincount(line[~hit], minlength=len(sizes))
            offsets = pa.array(np.r_[0, np.cumsum(left)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(offsets, pa.array(codes[~hit])),
                    pa.ListArray.from_arrays(offsets, pa.array(times[~hit])),
                ],
                names=[*names, "best", "total", "codes", "times"],
            )

    schema = ", ".join(ALIGNED.split(", ")[:7]) + ", best long, total long, codes array<long>, times array<int>"
    looked = texts.mapInArrow(look_up, schema)
    result = [F.col(n) for n in names[1:6]]
    if counts.filter(F.col("held") < least).isEmpty():
        return looked.select(
            *result, F.col("best").alias("n_best"), F.col("total").alias("count_sum"), "groups_sha256"
        )
    looked = materialise(looked, "looked-up")
    rare = looked.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    rare = rare.select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("n"))
    light = counts.filter(F.col("held") < least)
    added = rare.join(light, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("held")).alias("more"),
    )
    both = looked.join(added, "row", "left")
    return both.select(
        *result,
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
