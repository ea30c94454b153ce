"""Packing of documents into token sequences: first-fit decreasing over a tournament tree.

Documents are dealt to groups by a hash of id and text, and every group is packed alone.
A document longer than a sequence first fills whole sequences; what remains of each
document is placed, longest first, into the first sequence with room, which a tournament
tree over the rooms finds in logarithmic time. At the end the emptiest sequences of the group are cut up
to fill the gaps of the others, so at most one sequence of a group is not full.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.common import id_and_text

#: Tokens of a sequence, the id after each document, text bytes of one group (about).
CAPACITY, END_ID, GROUP_BYTES = 2048, 1, 8 << 20



#: Fixed value: the token pattern of byte-level BPE files that split by their own rule.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE file whose ids follow the order of its merges, else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
    own = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
    letters, vocabulary = byte_letters(), model.get("vocab", {})
    if not (plain and own) or any(set(token) - set(letters) for token in vocabulary):
        return None
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merged = [vocabulary[a + b] for a, b in pairs]
    if merged != sorted(merged) or len(vocabulary) != 256 + len(merged):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class Tokens:
    """Ids of whole texts under a tokenizer file.

    Plain byte-level BPE, of which a file's ranks say everything, is encoded by the
    tiktoken library, which gives the same ids (tested) in a fraction of the time. With
    ``added`` a text that holds an added token goes through the tokenizers library with its
    defaults, which gives that token's id; else such strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        ranks = byte_level_ranks(path)
        self.added, self.whole = [], None
        if added:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self.added = [token.content for token in own.get_added_tokens_decoder().values()]
            self.whole = lambda text: own.encode(text, add_special_tokens=False).ids
        if ranks is not None:
            import tiktoken

            fast = tiktoken.Encoding(
                "own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            self.ids = fast.encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        ids = self.whole if any(token in text for token in self.added) else self.ids
        return np.array(ids(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def tokens(path: str, added: bool = False) -> Tokens:
    """One per worker process, kept over its tasks."""
    return Tokens(path, added)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by index) of every bin; ties keep the order given."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, first token, tokens)."""
    sequences, rest = [], []
    for doc, length in enumerate(lengths):
        whole = length - length % capacity
        sequences += [[(doc, start, capacity)] for start in range(0, whole, capacity)]
        if length > whole:
            rest.append((doc, whole, length - whole))
    bins = [
        [rest[i] for i in items] for items in first_fit_decreasing([r[2] for r in rest], capacity)
    ]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        into, source = order[low], order[high]
        gap = capacity - used[into]
        if not gap:
            low += 1
            continue
        doc, start, length = bins[source].pop()
        moved = min(gap, length)
        if moved < length:
            bins[source].append((doc, start, length - moved))
        bins[into].append((doc, start + length - moved, moved))
        used[into] += moved
        used[source] -= moved
        if not used[source]:
            high -= 1
    return sequences + [b for b in bins if b]


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _pack_group(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(key, table):
        # The order of rows in a group must not depend on how they arrived.
        table = table.sort_by([("doc_id", "ascending"), ("order", "ascending")])
        encoder = tokens(path, added=True)
        ids = [encoder.encode(text.as_py()) + end for text in table.column("text")]
        docs = table.column("doc_id").to_pylist()
        columns: list[list] = [[] for _ in range(7)]
        base = key[0].as_py() << 32
        for number, sequence in enumerate(pack([len(x) // 4 for x in ids], capacity)):
            offset = 0
            for doc, start, length in sequence:
                part = ids[doc][4 * start : 4 * (start + length)]
                values = (docs[doc], start, length, zlib.crc32(part), len(ids[doc]) // 4, base + number, offset)
                for column, value in zip(columns, values):
                    column.append(value)
                offset += length
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_bytes: int = GROUP_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every row of ``docs`` is one document: its ids and ``end_id``. A null or empty text
    is ``end_id`` alone. The tokenizer file must be at ``tokenizer_path`` on every worker.
    The number of groups follows the bytes of text, so a task holds about ``group_bytes``
    (or one longer document). Repeated rows are documents of their own and are spread like
    others; which group a document falls in also depends on its input partition. A null id
    stays null. No rows give no rows.
    """
    read = id_and_text(docs, id_col, text_col)
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    # The input partition spreads copies of one row; a task that runs again has the same.
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups))
    dealt = read.withColumns({"order": F.xxhash64("doc_id", "text"), "group": group})
    return dealt.groupBy("group").applyInArrow(_pack_group(tokenizer_path, capacity, end_id), SCHEMA)
