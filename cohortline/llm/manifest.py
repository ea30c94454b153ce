"""Merkle manifest of a table: leaf places by bitmap rank, levels by keyed slot arrays.

Each source keeps its ids as a bitmap of 64-bit words, of which only those with an id are
stored. Words of all partitions are merged by a bitwise or, and four levels of directories
hold the rows before each word (``FAN_BITS`` bits of the id a level, so no directory node is
large whatever the ids are). The place of a leaf is a rank query: the rows before its word
plus the bits before its own. No leaf is sorted.

Places are then cut into blocks of ``FAN ** STAGE`` slots. One group is one block: its digests fill
an array by slot and are hashed level by level; what remains of a block is a slot of the next
stage. A second pass goes down again and hands every block the path above it, so each leaf's
proof is known inside its own group. A group never holds more nodes than a block has slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import numbered, quoted

#: Nodes hashed together, levels of one block.
FAN, STAGE = 3, 7
#: Bits of an id that one level of the directories decides.
FAN_BITS = 14
#: Word of the rows without an id; lower than that of any id, at every level.
NO_ID = -(1 << 60)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(
    text: Column, doc_id: Column, source: Column, lang: Column, n_chars: Column
) -> Column:
    """Hex SHA-256 of one row's five fields."""
    whole = [doc_id.cast("long"), source, lang, n_chars.cast("long"), text]
    return F.sha2(F.concat(*map(_field, whole)), 256)


def without_breaks(doc_id: Column, text: Column) -> Column:
    """The text as the query tampers with it: no ``\\n`` where crc32 of the id is even."""
    even = F.crc32(doc_id.cast("long").cast("string").cast("binary")) % F.lit(2) == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _directory(words: DataFrame) -> DataFrame:
    """``words`` with the rows before each word (``base``) and of its tree (``held``)."""
    levels = [words.select("tree", F.col("word").alias("node"), "total")]
    for _ in range(3):
        up = F.shiftright("node", FAN_BITS)
        levels.append(levels[-1].groupBy("tree", up.alias("node")).agg(F.sum("total").alias("total")))

    def before(*group: str) -> Column:
        along = Window.partitionBy(*group).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("total").over(along), F.lit(0))

    held = F.sum("total").over(Window.partitionBy("tree"))
    based = levels[-1].select("tree", "node", before("tree").alias("base"), held.alias("held"))
    for level in reversed(levels[:-1]):
        upper = based.select("tree", F.col("node").alias("up"), F.col("base").alias("above"), "held")
        local = level.withColumn("up", F.shiftright("node", FAN_BITS))
        local = local.withColumn("local", before("tree", "up"))
        based = local.join(upper, ["tree", "up"]).select(
            "tree", "node", (F.col("above") + F.col("local")).alias("base"), "held"
        )
    return words.join(based.withColumnRenamed("node", "word"), ["tree", "word"])


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, claimed, n) with ``rank`` and ``held``; stored.

    Rows of one tree and id take consecutive places in the order of their digests.
    """
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID)).alias("word")
    pos = F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("pos")
    ids = rows.groupBy("tree", "doc_id").agg(F.sum("n").alias("w")).select("tree", word, pos, "w")
    bit = F.expr("shiftleft(1L, pos)")
    extra = F.when(F.col("w") > 1, F.struct("pos", (F.col("w") - 1).alias("more")))
    words = ids.groupBy("tree", "word").agg(
        F.bit_or(bit).alias("bits"), F.sum("w").alias("total"), F.collect_list(extra).alias("extra")
    )
    indexed = _directory(materialise(words, "bitmap"))

    lower = F.expr("bit_count(bits & ~shiftleft(-1L, pos))")
    more = F.expr("aggregate(filter(extra, e -> e.pos < pos), 0L, (s, e) -> s + e.more)")
    weight = F.expr("1L + aggregate(filter(extra, e -> e.pos = pos), 0L, (s, e) -> s + e.more)")
    asked = rows.select("*", word, pos).join(indexed, ["tree", "word"])
    first = (F.col("base") + lower + more).alias("rank")
    found = asked.select(*rows.columns, first, "held", (weight != F.col("n")).alias("tied"))
    found = materialise(found, "ranked")
    tied = found.filter("tied")
    if tied.isEmpty():
        return found.drop("tied")
    # Equal ids: digests are spread evenly, so their first two bytes make small groups.
    key = F.struct("tree", "doc_id").alias("key")
    tied = tied.select("*", key, F.substring("leaf", 1, 2).alias("head"))
    past = (Window.unboundedPreceding, -1)
    heads = tied.groupBy("key", "head").agg(F.sum("n").alias("total"))
    by_head = Window.partitionBy("key").orderBy("head").rowsBetween(*past)
    heads = heads.select("key", "head", F.coalesce(F.sum("total").over(by_head), F.lit(0)).alias("heads"))
    inside = Window.partitionBy("key", "head").orderBy("leaf", "claimed").rowsBetween(*past)
    tied = tied.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = tied.join(heads, ["key", "head"]).withColumn(
        "rank", F.col("rank") + F.col("heads") + F.col("inside")
    )
    columns = [*rows.columns, "rank", "held"]
    return found.filter("not tied").select(columns).unionByName(placed.select(columns))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(held: int) -> int:
    """How often a tree of ``held`` nodes is reduced until one is left."""
    count = 0
    while held > 1:
        held, count = -(-held // FAN), count + 1
    return count


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones up."""
    found = [nodes]
    for _ in range(levels):
        nodes = [_digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        found.append(nodes)
    return found


def siblings(found: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """Digests left and right of a slot's node in its run, level by level."""
    path = []
    for nodes in found[:-1]:
        run = slot - slot % FAN
        path.append(("".join(nodes[run:slot]), "".join(nodes[slot + 1 : run + FAN])))
        slot //= FAN
    return path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """What a digest becomes along its siblings."""
    for left, right in path:
        digest = _digest(left + digest + right)
    return digest


def _written(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def _read(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in path.split(";")] if path else []


def _slotted(nodes: DataFrame, stage: int) -> DataFrame:
    """One row per node and block that its ``n`` copies reach: ``block, slot, copies``."""
    size = F.lit(FAN**stage)
    last = F.col("rank") + F.col("n") - 1
    spread = nodes.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("rank") / size), F.floor(last / size)))
    )
    start = F.greatest(F.col("rank"), F.col("block") * size)
    end = F.least(last + 1, (F.col("block") + 1) * size)
    spread = spread.withColumns({"slot": start - F.col("block") * size, "copies": end - start})
    return spread.drop("rank", "n")


def _nodes(stage: int, table: pa.Table) -> tuple[list[list[str]], int]:
    """All levels of one block, and its tree's number of nodes."""
    held = table.column("held")[0].as_py()
    slots = table.column("slot").to_pylist()
    copies = table.column("copies").to_pylist()
    array = [""] * sum(copies)
    for slot, count, leaf in zip(slots, copies, table.column("leaf").to_pylist()):
        array[slot : slot + count] = [leaf.hex()] * count
    return climb(array, min(stage, _levels(held))), held


def _of_stage(kernel: Callable, stage: int, above: bool = False) -> Callable:
    """``kernel`` as a function of a group's key and table (and the table above it)."""
    if above:
        return lambda key, table, path: kernel(stage, key, table, path)
    return lambda key, table: kernel(stage, key, table)


def _reduce(stage: int, key: tuple, table: pa.Table) -> pa.Table:
    found, held = _nodes(stage, table)
    tree, block = (k.as_py() for k in key)
    columns = [[tree], [block], [bytes.fromhex(found[-1][0])], [-(-held // FAN**stage)]]
    return pa.table(dict(zip(["tree", "rank", "leaf", "held"], columns)))


def _descend(stage: int, key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
    """The path of every node of a block: its own levels, then the block's path."""
    found, _ = _nodes(stage, table)
    rest = above.column("path")[0].as_py()
    slots = table.column("slot").to_pylist()
    first = key[1].as_py() * FAN**stage
    paths = []
    for slot in slots:
        own = _written(siblings(found, slot))
        paths.append(own + (";" if own and rest and rest[0] != "#" else "") + rest)
    return pa.table(
        {
            "tree": pa.array([key[0].as_py()] * len(slots), pa.string()),
            "rank": pa.array([first + s for s in slots], pa.int64()),
            "path": pa.array(paths, pa.string()),
        }
    )


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _prove(stage: int, key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
    """The result rows of one block of leaves."""
    found, _ = _nodes(stage, table)
    inner, outer = map(_read, above.column("path")[0].as_py().split("#"))
    rest = "".join(left + right for left, right in inner + outer)
    subroot = fold(found[-1][0], inner)
    root = fold(subroot, outer)
    folded = {}
    names = ["doc_id", "slot", "copies", "leaf", "claimed"]
    out = []
    for doc_id, first, copies, leaf, claimed in zip(*(table.column(n).to_pylist() for n in names)):
        for slot in range(first, first + copies):
            path = siblings(found, slot)
            proof = _digest("".join(left + right for left, right in path) + rest)
            top = fold(claimed.hex(), path)
            # Blocks untampered with end in one digest, so the rest is folded once.
            if top not in folded:
                folded = {top: fold(fold(top, inner), outer)}
            out.append((doc_id, leaf.hex(), subroot, root, proof, folded[top], folded[top] == root))
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = [part.split()[0] for part in RESULT.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _grown(slots: DataFrame, stage: int) -> tuple[list[DataFrame], DataFrame]:
    """Slots of every stage, and the last node of every tree."""
    stages = []
    while True:
        stages.append(slots)
        groups = slots.select("tree", "block", "slot", "copies", "leaf", "held").groupBy("tree", "block")
        schema = "tree string, rank long, leaf binary, held long"
        nodes = materialise(groups.applyInArrow(_of_stage(_reduce, stage), schema), "nodes")
        if (nodes.agg(F.max("held")).first()[0] or 1) <= 1:
            return stages, nodes
        slots = _slotted(nodes.withColumn("n", F.lit(1)), stage)


def _paths(stages: list[DataFrame], top: DataFrame, stage: int) -> DataFrame:
    """``top`` (tree, rank, path) brought down through ``stages``, last one first."""
    for slots in reversed(stages):
        cut = slots.select("tree", "block", "slot", "copies", "leaf", "held").groupBy("tree", "block")
        above = top.withColumnRenamed("rank", "block").groupBy("tree", "block")
        down = cut.cogroup(above).applyInArrow(
            _of_stage(_descend, stage, True), "tree string, rank long, path string"
        )
        top = materialise(down, "paths")
    return top


def manifest(
    docs: DataFrame,
    claimed_text: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    lang_col: str = "lang",
    chars_col: str = "n_chars",
    text_col: str = "text",
    stage: int = STAGE,
) -> DataFrame:
    """Digest, roots and proof of every row, and what a claimed text folds to.

    ``claimed_text`` is the text to be checked against the manifest (by default the text
    itself): ``folded_root`` is recomputed from it and the original siblings, ``verified``
    says whether it equals ``root``. Rows of a source stand in order of id, those without an
    id first; rows of one id in order of their digests. Equal rows take a place and a proof
    each, and give a result row each. Nulls, empty and long texts are fields like any others;
    no rows give no rows. Other columns are not read, so their names can't clash. ``stage`` is the
    number of levels that one group hashes.
    """
    doc_id, source, text = quoted(id_col).cast("long"), quoted(source_col), quoted(text_col)
    claimed = text if claimed_text is None else claimed_text
    rest = (doc_id, source, quoted(lang_col), quoted(chars_col))
    tree = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))
    leaves = docs.select(
        tree.alias("tree"),
        doc_id.alias("doc_id"),
        F.unhex(leaf_digest(text, *rest)).alias("leaf"),
        F.unhex(leaf_digest(claimed, *rest)).alias("claimed"),
    )
    rows = leaves.groupBy("tree", "doc_id", "leaf", "claimed").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(rows, "leaves")
    slots = materialise(_slotted(_ranked(rows), stage), "slots")
    stages, subroots = _grown(slots, stage)

    # The sources are the leaves of one more tree.
    order = numbered(subroots.select(F.col("tree").alias("source"), "leaf"), "source")
    top = order.select(F.lit("").alias("tree"), F.col("number").alias("rank"), "source", "leaf")
    top = top.withColumns({"held": F.lit(subroots.count()), "n": F.lit(1)})
    top = materialise(_slotted(top, stage), "sources")
    above, roots = _grown(top, stage)
    ends = _paths(above, roots.select("tree", "rank", F.lit("").alias("path")), stage)
    places = top.select("source", (F.col("block") * FAN**stage + F.col("slot")).alias("rank"))
    seeds = places.join(ends, "rank").select(
        F.col("source").alias("tree"),
        F.lit(0).cast("long").alias("rank"),
        F.concat(F.lit("#"), "path").alias("path"),
    )
    paths = _paths(stages[1:], seeds, stage).withColumnRenamed("rank", "block")
    groups = slots.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
    return groups.applyInArrow(_of_stage(_prove, stage, True), RESULT)
