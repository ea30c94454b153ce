"""Numbered slots: the first records of a group side by side in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortline.functions.columns import any_non_null, column_range, named


def month_of(df: DataFrame, date: str = "date") -> DataFrame:
    """Add calendar ``year`` and ``month`` of ``date``."""
    return df.withColumns({"year": F.year(date), "month": F.month(date)})


def widen_slots(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    slots: int,
    count_name: str,
    width: int = 1,
) -> DataFrame:
    """One row per group: its size and ``<value>_<slot>`` for its first records.

    Values keep their types. Records beyond ``slots`` have no column, and
    ``overflow_count`` says how many there are. ``order`` should be total;
    ``values`` break remaining ties. Only the first ``slots`` records of a group
    leave each input partition, and the size comes from a separate aggregate, so
    a very large group is never gathered.
    """
    ties = [v for v in values if v not in order]
    sort = [named(c).asc_nulls_last() for c in order]
    if ties:
        sort.append(F.struct(*[named(v) for v in ties]).asc())
    record = F.struct(*[named(v).alias(f"v{j}") for j, v in enumerate(values)])
    group = [named(k) for k in keys]
    numbered = (
        df.withColumn("_slot", F.row_number().over(Window.partitionBy(*group).orderBy(*sort)))
        .filter(F.col("_slot") <= slots)
        .select(*group, "_slot", record.alias("_record"))
    )
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    # Both parts lie by key already; grouping their union moves nothing again.
    both = numbered.unionByName(sizes, allowMissingColumns=True)
    # One aggregate per slot: a slot holds at most one record of a group.
    held = [
        F.max(F.when(F.col("_slot") == i, F.col("_record"))).alias(f"_s{i}")
        for i in range(1, slots + 1)
    ]
    wide = both.groupBy(*group).agg(F.max("_size").alias(count_name), *held)
    overflow = F.greatest(F.col(count_name) - slots, F.lit(0)).alias("overflow_count")
    columns = [
        F.col(f"_s{i}.v{j}").alias(f"{v}_{i:0{width}d}")
        for i in range(1, slots + 1)
        for j, v in enumerate(values)
    ]
    return wide.select(*group, count_name, overflow, *columns)


def slot_occupancy(df: DataFrame, keys: list[str], chunk: int = 1_000_000) -> DataFrame:
    """(idx, n): how many groups hold at least ``idx`` records, up to the largest.

    Works on group sizes. There are at most about sqrt(2 * rows) distinct sizes,
    since distinct sizes add up to no more than the rows, so ranking them in one
    window is safe. ``n`` is constant between two sizes; each such run is
    expanded in chunks.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    steps = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    falling = Window.orderBy(F.desc("size"))
    runs = steps.select(
        (F.coalesce(F.lead("size").over(falling), F.lit(0)) + 1).alias("low"),
        F.col("size").alias("high"),
        F.sum("groups").over(falling.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
    )
    starts = runs.select(
        F.explode(F.sequence("low", "high", F.lit(chunk).cast("long"))).alias("start"), "high", "n"
    )
    # Chunks are dealt out again, so one very long run is expanded by many tasks.
    return starts.repartition("start").select(
        F.explode(
            F.sequence("start", F.least(F.col("high"), F.col("start") + (chunk - 1)))
        ).alias("idx"),
        "n",
    )


SCORE_VALUES = ("date", "rom", "score")
SCORE_SLOTS = 12
DIAGNOSIS_SLOTS = 9


def score_months_wide(
    scores: DataFrame,
    tie_break: tuple[str, ...] = (),
    slots: int = SCORE_SLOTS,
    keys: tuple[str, ...] = ("client_id", "year", "month"),
) -> DataFrame:
    """Scores per client-month in slots ordered by instrument and date."""
    order = ["rom", "date", *tie_break]
    return widen_slots(scores, list(keys), order, list(SCORE_VALUES), slots, "nrom", 2)


def diagnosis_values(dx: DataFrame) -> list[str]:
    """Diagnosis fields that count as content."""
    return ["gaf1", "gaf2", *column_range(dx, "ax_1_1", "ax_2_2"), "ax_3", "ax_4"]


def with_content(dx: DataFrame) -> DataFrame:
    """Diagnoses with at least one filled field."""
    return dx.filter(any_non_null(*diagnosis_values(dx)))


def diagnosis_months_wide(
    dx: DataFrame, order: tuple[str, ...] = ("date",), slots: int = DIAGNOSIS_SLOTS
) -> DataFrame:
    """Diagnoses with content per client-month in numbered slots."""
    values = ["date", *diagnosis_values(dx)]
    filled = month_of(with_content(dx))
    return widen_slots(
        filled, ["client_id", "year", "month"], list(order), values, slots, "ndiag"
    )
