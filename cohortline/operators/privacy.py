"""Replacing client ids by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.core.skew import lookup_join


def pseudonymise(df: DataFrame, keys: DataFrame, on_missing: str = "keep") -> DataFrame:
    """Put ``key`` in the place of ``client_id``.

    A client without a key keeps the row with a null id (``keep``), loses the
    row (``drop``), or stops the job (``fail``).
    """
    if on_missing not in ("keep", "drop", "fail"):
        raise ValueError(f"on_missing must be keep, drop or fail, not {on_missing!r}")
    renamed = keys.select("client_id", F.col("key").alias("_key"))
    # Rows of one client, or of none, may be many: the join broadcasts the keys or spreads them.
    joined = lookup_join(df, renamed, "client_id", "inner" if on_missing == "drop" else "left")
    key = F.col("_key")
    if on_missing == "drop":
        joined = joined.filter(key.isNotNull())
    if on_missing == "fail":
        key = F.coalesce(key, F.raise_error(F.lit("client without key")).cast("string"))
    return joined.withColumn("client_id", key).drop("_key")
