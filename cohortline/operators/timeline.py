"""Events on a clock that starts at each client's index date.

A timeline row is additive: it carries counts and sums next to its keys, so a
raw timeline (one row per event) and a compacted one (one row per client,
month, period, category and team) feed the same summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.skew import measured
from cohortline.core.spec import CohortSpec
from cohortline.core.workspace import materialise
from cohortline.functions.columns import ascii_text

HISTORY = "history"
LOOK_BACK = "look_back"
FOLLOW_UP = "follow_up"
PRIOR = (HISTORY, LOOK_BACK)
MONTHS = (LOOK_BACK, FOLLOW_UP)
UNMATCHED = "<na>"

KEYS = ("client_id", "year", "month", "period", "category", "team_id")
SUMS = ("n", "nb", "unknown", "mins", "minsb", "minss", "listed")


def category_key(column: Column) -> Column:
    """Lower-case category; missing ones form a group of their own."""
    return F.coalesce(F.lower(column), F.lit(UNMATCHED))


def clean_descriptions(types: DataFrame, column: str = "description") -> DataFrame:
    return types.withColumn(column, ascii_text(F.col(column)))


def category_values(types: DataFrame) -> list[str]:
    """Sorted category keys of the dimension, with the unmatched group last.

    These become column names. For thousands of categories, ``summaries.activity_maps`` keeps
    them in maps instead, and ``category_catalogue`` lists them as a table.
    """
    keys = types.select(category_key(F.col("description_cat")).alias("c")).distinct()
    found = [row[0] for row in keys.collect()]
    return [*sorted(c for c in found if c != UNMATCHED), UNMATCHED]


def event_timeline(
    interventions: DataFrame,
    types: DataFrame | None,
    index: DataFrame,
    spec: CohortSpec,
    derived: bool = False,
) -> DataFrame:
    """Additive event rows up to the end of follow-up, with period and category.

    Without ``types`` no category is looked up, for summaries that need none.
    ``derived`` says that ``interventions`` is itself a result of joins. It is
    then stored first, if it has to be searched for frequent keys.
    """
    read = interventions.select(
        "client_id",
        "date",
        "dbc_id",
        "mins_direct_staff",
        "mins_indirect_staff",
        "intervention_type_id",
        "team_id",
    )
    sides = [measured(index.select("client_id", "dx_date"), "client_id")]
    if types is not None:
        coded = types.select("intervention_type_id", "description_cat")
        sides.append(measured(coded, "intervention_type_id"))
    if derived and not all(side.fits for side in sides):
        read = materialise(read, "events")
    events = sides[0].join(read).withColumn("day", F.datediff("date", "dx_date"))
    events = events.filter(F.col("day") <= spec.follow_up_days)
    if types is None:
        events = events.withColumn("description_cat", F.lit(None).cast("string"))
    else:
        events = sides[1].join(events, "left", source=read)

    basic = F.coalesce(F.col("dbc_id") < 0, F.lit(False)).cast("long")
    direct, indirect = F.col("mins_direct_staff"), F.col("mins_indirect_staff")
    total = direct + indirect
    known = F.coalesce(total, F.lit(0.0))
    period = (
        F.when(F.col("day") < -spec.look_back_days, HISTORY)
        .when(F.col("day") < 0, LOOK_BACK)
        .otherwise(FOLLOW_UP)
    )
    return events.select(
        "client_id",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        period.alias("period"),
        category_key(F.col("description_cat")).alias("category"),
        "team_id",
        F.col("day").alias("day_first"),
        F.col("day").alias("day_last"),
        F.lit(1).cast("long").alias("n"),
        basic.alias("nb"),
        total.isNull().cast("long").alias("unknown"),
        known.alias("mins"),
        (known * basic).alias("minsb"),
        (known * (1 - basic)).alias("minss"),
        (F.coalesce(direct, F.lit(0.0)) + F.coalesce(indirect, F.lit(0.0))).alias("listed"),
    )


def compact(timeline: DataFrame) -> DataFrame:
    """One row per client, month, period, category and team."""
    return timeline.groupBy(*KEYS).agg(
        F.min("day_first").alias("day_first"),
        F.max("day_last").alias("day_last"),
        *[F.sum(c).alias(c) for c in SUMS],
    )


def in_periods(timeline: DataFrame, periods: tuple[str, ...]) -> DataFrame:
    return timeline.filter(F.col("period").isin(*periods))
