"""Joins that stay balanced when one key holds a large share of the rows.

``lookup_join`` joins a large table to a side with at most one row per key. The
side is measured first. Within the byte bound it is broadcast and the large
table does not move. Beyond the bound both sides are shuffled by key, and the
most frequent keys are spread over several partitions: rows of such a key get a
salt, and the (few) matching side rows are copied once per salt.

The salt is the number of the input partition, not a random number or a hash of
the row: a task that runs again after a lost executor gives its rows the same
salt, and identical copies of one row still spread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1024
TRACKED_KEYS = 4096
SALTS = 64


def _column_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, T.ArrayType) and _fixed(field.dataType.elementType):
        return F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)) * F.lit(16) + F.lit(16)
    if _fixed(field.dataType):
        return F.lit(16)
    # Arrays of strings, maps and structs: their text is about as long as their content.
    written = F.octet_length(F.to_json(F.struct(column)))
    return F.coalesce(written, F.lit(0)) * F.lit(4) + F.lit(64)


def _fixed(kind: T.DataType) -> bool:
    """Whether every value of the type has the same small size."""
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType))


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``, measured by one aggregate."""
    width = sum((_column_bytes(f) for f in df.schema.fields), F.lit(16))
    return df.select(F.sum(width.cast("long"))).first()[0] or 0


def frequent_keys(df: DataFrame, key: str, limit: int | None = None) -> list:
    """Up to ``limit`` of the most frequent non-null keys; reads one column only.

    Without a limit only keys that more than one row in ``HOT_KEYS`` has: rarer ones need no
    copies of their side rows.

    Each input partition keeps a bounded sketch of its frequent keys, and the
    sketches are merged in two steps, so no key is shuffled. A key with more than
    about a thousandth of the rows is always found. The answer only decides how
    rows are routed; it never changes a result.
    """
    sketched = (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("p"))
        .groupBy("p")
        .agg(F.expr(f"approx_top_k_accumulate(k, {TRACKED_KEYS})").alias("s"), F.count("*").alias("n"))
    )
    merged = f"approx_top_k_combine(s, {TRACKED_KEYS})"
    # Grouped, so that no rows give no sketch instead of an empty one.
    found = (
        sketched.groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_estimate({merged}, {limit or HOT_KEYS})").alias("top"), F.sum("n").alias("rows"))
        .first()
    )
    least = found["rows"] / HOT_KEYS if found and limit is None else 0
    return [row["item"] for row in found["top"] if row["count"] > least] if found else []


def spread_join(
    fact: DataFrame,
    side: DataFrame,
    key: str,
    how: str = "inner",
    hot: list | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Shuffle join in which frequent and missing keys use ``salts`` partitions.

    The join is always a sort-merge join: the planner does not count the copies of the side, so
    it might send them all to every task by way of the driver.
    """
    if hot is None:
        hot = frequent_keys(fact, key)
    column = F.col(key)
    is_hot = column.isin(hot) if hot else F.lit(False)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = fact.withColumn(
        "_salt", F.when(column.isNull() | is_hot, salt).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    copied = side.withColumn("_salt", F.explode(copies))
    return salted.join(copied.hint("merge"), [key, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Lookup:
    """A side of a join, measured once."""

    table: DataFrame
    key: str | list[str]
    fits: bool

    def join(
        self, fact: DataFrame, how: str = "inner", source: DataFrame | None = None
    ) -> DataFrame:
        """Join ``fact``; its frequent keys are looked up in ``source`` if given.

        ``source`` holds the key column of ``fact`` (or of more rows) and is
        cheaper to read, for a ``fact`` that is itself the result of joins.
        """
        if self.fits:
            return fact.join(F.broadcast(self.table), self.key, how)
        if not isinstance(self.key, str):
            # One text key that tells all values apart; no match for a null, as in a join.
            known = reduce(and_, (F.col(k).isNotNull() for k in self.key))
            packed = F.when(known, F.to_json(F.struct(*self.key)))
            side = self.table.withColumn("_key", packed).drop(*self.key)
            return Lookup(side, "_key", False).join(fact.withColumn("_key", packed), how).drop("_key")
        hot = frequent_keys(fact if source is None else source, self.key)
        return spread_join(fact, self.table, self.key, how, hot)


def measured(side: DataFrame, key: str | list[str], max_bytes: int | None = None) -> Lookup:
    """Measure a side and decide whether it may be broadcast."""
    bound = BROADCAST_BYTES if max_bytes is None else max_bytes
    return Lookup(side, key, table_bytes(side) <= bound)


def lookup_join(
    fact: DataFrame,
    side: DataFrame,
    key: str | list[str],
    how: str = "inner",
    max_bytes: int | None = None,
) -> DataFrame:
    """Join ``fact`` to a side with unique keys: broadcast if it fits, else spread."""
    return measured(side, key, max_bytes).join(fact, how)
