"""Exact copies by naming blocks: equal texts end in one integer, others never do.

A text is cut into blocks of ``BLOCK_BYTES`` bytes. Blocks are sorted, and every run of equal
ones takes one integer name (Karp, Miller & Rosenberg 1972). Two adjacent names form a pair,
pairs are sorted and named in the same way, and so on: a text of n blocks has one name after
about log2(n) rounds. Content is compared at every step, never a hash of it, so the identity
``(blocks, name)`` can't collide. DataFrame functions only.

A name is the smallest place of its run, where a place numbers the blocks of all texts; the
places of one text are consecutive. The contents of very frequent blocks are few and known
beforehand (``HOT_BLOCKS``), so they are named by a broadcast join and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortline.core.skew import frequent_keys
from cohortline.core.workspace import materialise
from cohortline.llm.common import quoted

#: Bytes of a block, and frequent blocks whose contents (at most as many bytes) are broadcast.
BLOCK_BYTES, HOT_BLOCKS = 4096, 1024
#: Named beforehand, blocks keep the window sort of the others in groups of so many places.
SPREAD_BITS = 10
#: Second name of the last pair of an odd row of names.
NONE = -(1 << 62)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block; ``place`` is unique, consecutive within a text, and cheap."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(raw) / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.substring(F.col("raw"), i * BLOCK_BYTES + 1, BLOCK_BYTES),
    )
    read = docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        raw.alias("raw"),
        count.alias("blocks"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    cut = read.select("doc_id", "blocks", "text_sha256", F.posexplode(cut).alias("at", "block"))
    first = F.col("at") == 0
    return cut.select(
        F.monotonically_increasing_id().alias("place"),
        "at",
        "blocks",
        "block",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("text_sha256")).alias("text_sha256"),
    )


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """``row, at, blocks, name`` of every block; ``row`` is the place of its text's first."""
    hashed = blocks.withColumn("hash", F.xxhash64("block"))
    hot = frequent_keys(hashed.select("hash"), "hash", HOT_BLOCKS)
    # Frequent contents in the order of the bytes: names below zero.
    content = hashed.filter(F.col("hash").isin(hot) if hot else F.lit(False))
    content = content.groupBy("block").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    ordered = F.row_number().over(Window.orderBy("block")).cast("long")
    content = materialise(content.select("block", (-ordered).alias("known")), "hot-blocks")

    marked = blocks.join(F.broadcast(content), "block", "left")
    rest = F.col("known").isNull()
    run = Window.partitionBy("content", "spread")
    named = marked.select(
        "place",
        "at",
        "blocks",
        "doc_id",
        "text_sha256",
        "known",
        F.when(rest, F.col("block")).alias("content"),
        F.when(~rest, F.shiftright("place", SPREAD_BITS)).alias("spread"),
    ).withColumn("name", F.coalesce("known", F.min("place").over(run)))
    row = (F.col("place") - F.col("at")).alias("row")
    return named.select(row, "at", "blocks", "name", "doc_id", "text_sha256")


def _named_pairs(rows: DataFrame) -> DataFrame:
    """The next round: one name for each two adjacent ones (a last one is paired with none)."""
    left = F.col("at") % 2 == 0
    pairs = rows.groupBy("row", F.shiftright("at", 1).alias("at")).agg(
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(NONE)).alias("b"),
        F.max("left").alias("was"),
    )
    pairs = pairs.select("row", "at", "a", "b", F.shiftright(F.col("was") + 1, 1).alias("left"))
    pairs = materialise(pairs, "pairs")
    # A place of a pair is that of its text plus its own; equal pairs are combined before the shuffle.
    names = pairs.groupBy("a", "b").agg(F.min(F.col("row") + F.col("at")).alias("name"))
    return pairs.join(names, ["a", "b"]).select("row", "at", "left", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, text_sha256, blocks, name`` of every row, stored.

    Two texts are equal exactly if ``blocks`` and ``name`` are. ``row`` is unique.
    """
    named = materialise(_named_blocks(_blocks(docs, id_col, text_col)), "named-blocks")
    short = named.filter("blocks = 1").select("row", "doc_id", "text_sha256", "blocks", "name")
    rows = named.filter("blocks > 1").select("row", "at", F.col("blocks").alias("left"), "name")
    done, most = [], named.agg(F.max("blocks")).first()[0] or 1
    while most > 1:
        rows = materialise(_named_pairs(rows), "names")
        most = -(-most // 2)
        done.append(rows.filter("left = 1").select("row", "name"))
        rows = rows.filter("left > 1")
    if not done:
        return short
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    head = named.filter("blocks > 1 and at = 0").select("row", "doc_id", "text_sha256", "blocks")
    whole = head.join(found, "row").select(short.columns)
    return materialise(short.unionByName(whole), "identities")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Of equal texts the row with the largest id stays; of several rows with that id one, and
    one where no row has an id (``keep_id`` is null then). A null text counts as empty, so all
    null and empty texts are one group. Nothing else is changed before texts are compared. No
    rows give no rows. Other columns are not read, so their names can't clash.
    """
    named = identities(docs, id_col, text_col)
    groups = named.groupBy("blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )
    # Texts without a copy need no partner; frequent identities are split by adaptive execution.
    groups = materialise(groups.filter("group_size > 1"), "copies")
    both = named.join(groups, ["blocks", "name"], "left")
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
