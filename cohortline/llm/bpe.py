"""Byte-level BPE by tree reduction, and decoding up the tree.

A match of the token pattern is encoded as a tree: halves are encoded recursively down to
short leaves, and neighbours are joined. At a join only the ids near the seam can
change. A window around the seam is encoded anew and doubled until the ids at both of its
edges are stable with the ids outside. Two ids are stable side by side if encoding their
joined bytes gives them back; a row of ids in which all neighbours are stable is the
encoding of its bytes, so the rest needs no look (test: equal to the tiktoken library).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortline.llm.common import Cache, id_and_text, slices
from cohortline.llm.pretokens import chunks

#: Longest leaf in bytes, first window in ids on either side, ids concatenated at once.
LEAF, WINDOW, DECODED = 16, 2, 4096
#: Pieces of text whose ids a worker remembers, per kind and generation.
REMEMBERED = 300_000


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.matches = Cache(self._match, REMEMBERED)
        self.first = Cache(self._piece, REMEMBERED)
        self.later = Cache(lambda piece: self._piece(" " + piece), REMEMBERED)
        self.stable = Cache(lambda pair: self.leaf(pair[0] + pair[1]) == list(pair), 100_000)

    def leaf(self, data: bytes) -> list[bytes]:
        """Tokens of a short text: the pair of lowest rank merges first, then the next."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 1
        get = self.ranks.get
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of two encoded neighbours together."""
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            inner = self.leaf(b"".join(left[a:] + right[:b]))
            if (not a or self.stable[left[a - 1], inner[0]]) and (
                b == len(right) or self.stable[inner[-1], right[b]]
            ):
                return left[:a] + inner + right[b:]
            size *= 2

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def _match(self, match: str) -> bytes:
        data = match.encode("utf-8")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.tree(data)]
        return np.array(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        cut = chunks(text)
        return self.first[cut[0]] + b"".join(map(self.later.__getitem__, cut[1:]))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids; halves are decoded apart and concatenated."""
        if len(ids) <= 4 * DECODED:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        middle = len(ids) // 8 * 4
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, kept over its tasks."""
    return Encoder(path, pattern)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row.

    A null or empty text has no ids; a null id and repeated rows keep their rows. The file
    of ranks must be at ``ranks_path`` on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in slices(batches):
            ids = [own.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``n_tokens``, ``ids_sha256``, ``decoded`` bytes and their
    ``decoded_sha256``. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in slices(batches):
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            back = [own.decode(x) for x in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array(back, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string"
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
