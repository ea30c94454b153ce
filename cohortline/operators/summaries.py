"""Care summaries and activity features over an additive timeline."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortline.core.skew import lookup_join
from cohortline.functions.aggregates import half_even
from cohortline.functions.columns import with_labels
from cohortline.operators.timeline import FOLLOW_UP, MONTHS, PRIOR, UNMATCHED, category_key, in_periods

MONTH_KEYS = ("client_id", "year", "month")

# Readable labels of the summary columns.
SUMMARY_LABELS = {
    "n": "Number of Interventions",
    "nb": "Number of BGGZ Interventions",
    "ns": "Number of SGGZ Interventions",
    "mins": "Minutes of Interventions",
    "minsb": "Minutes of BGGZ Interventions",
    "minss": "Minutes of SGGZ Interventions",
}


def _where(test: Column | None, column: Column) -> Column:
    return column if test is None else F.when(test, column)


def _complete_minutes(name: str, test: Column | None = None) -> Column:
    """Rounded minutes, missing if the minutes of one event are unknown."""
    complete = F.sum(_where(test, F.col("unknown"))) == 0
    return F.when(complete, half_even(F.sum(_where(test, F.col(name)))))


def prior_columns(test: Column | None = None) -> list[Column]:
    """Aggregates over prior care; all missing for a client without prior rows."""
    events = F.sum(_where(test, F.col("n")))
    minutes = F.coalesce(_complete_minutes("mins", test), F.lit(0.0))
    return [
        (-F.min(_where(test, F.col("day_first")))).alias("days_prev"),
        events.alias("n_prev"),
        F.when(events.isNotNull(), minutes).alias("mins_prev"),
    ]


def care_columns(test: Column | None = None) -> list[Column]:
    """Aggregates over care: last day, events and minutes, in total and by kind."""
    events, basic = (F.sum(_where(test, F.col(c))) for c in ("n", "nb"))
    return [
        F.max(_where(test, F.col("day_last"))).alias("days"),
        events.alias("n"),
        basic.alias("nb"),
        (events - basic).alias("ns"),
        *[_complete_minutes(c, test).alias(c) for c in ("mins", "minsb", "minss")],
    ]


def event_counts(categories: list[str], test: Column | None = None) -> list[Column]:
    """One ``n_<category>`` aggregate per category, 0 where there is none."""
    return [
        F.coalesce(F.sum(_where(_both(test, c), F.col("n"))), F.lit(0)).alias(f"n_{c}")
        for c in categories
    ]


def minute_sums(categories: list[str], test: Column | None = None) -> list[Column]:
    """One ``mins_<category>`` aggregate per category, 0 where there is none."""
    return [
        F.coalesce(half_even(F.sum(_where(_both(test, c), F.col("listed")))), F.lit(0.0)).alias(
            f"mins_{c}"
        )
        for c in categories
    ]


def _both(test: Column | None, category: str) -> Column:
    same = F.col("category") == category
    return same if test is None else test & same


def prior_care_summary(timeline: DataFrame) -> DataFrame:
    """Furthest day back, events and minutes before the index date, per client."""
    return in_periods(timeline, PRIOR).groupBy("client_id").agg(*prior_columns())


def post_index_summary(timeline: DataFrame) -> DataFrame:
    """Care from the index date to the end of follow-up, per client."""
    table = in_periods(timeline, (FOLLOW_UP,)).groupBy("client_id").agg(*care_columns())
    return with_labels(table, SUMMARY_LABELS)


def activity_long(timeline: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Events and rounded minutes per ``keys`` and category (long form)."""
    return timeline.groupBy(*keys, "category").agg(
        F.sum("n").alias("n"), half_even(F.sum("listed")).alias("mins")
    )


def activity_features(timeline: DataFrame, categories: list[str], minutes: bool) -> DataFrame:
    """Wide follow-up features per client: minutes or event counts by category."""
    columns = minute_sums(categories) if minutes else event_counts(categories)
    return in_periods(timeline, (FOLLOW_UP,)).groupBy("client_id").agg(*columns)


def activity_maps(timeline: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Events and rounded minutes per ``keys`` as maps by category, for any number of categories.

    (keys, n, mins): a category without an event is not in the maps. Built from the long form, so
    the width of a row follows its own categories, not those of the whole table.
    """
    entry = F.struct("category", "n", "mins")
    listed = activity_long(timeline, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("held"))
    columns = {c: F.map_from_arrays("held.category", f"held.{c}") for c in ("n", "mins")}
    return listed.withColumns(columns).drop("held")


def category_catalogue(types: DataFrame) -> DataFrame:
    """(category, n_column, mins_column) of every category of the dimension and the unmatched one."""
    unmatched = types.sparkSession.createDataFrame([(UNMATCHED,)], "category string")
    keys = types.select(category_key(F.col("description_cat")).alias("category")).union(unmatched)
    columns = [F.concat(F.lit(p), "category").alias(f"{p}column") for p in ("n_", "mins_")]
    return keys.distinct().select("category", *columns)


def widen_maps(maps: DataFrame, categories: list[str]) -> DataFrame:
    """The given categories of ``activity_maps`` as columns, 0 where there is no event."""
    zero = {"n": F.lit(0), "mins": F.lit(0.0)}
    wide = [
        F.coalesce(F.try_element_at(F.col(p), F.lit(c)), zero[p]).alias(f"{p}_{c}")
        for p in ("n", "mins")
        for c in categories
    ]
    return maps.select(*[c for c in maps.columns if c not in zero], *wide)


def client_month_summary(timeline: DataFrame) -> DataFrame:
    """Care per client and calendar month, from look-back to end of follow-up."""
    table = in_periods(timeline, MONTHS).groupBy(*MONTH_KEYS).agg(*care_columns())
    return with_labels(table, SUMMARY_LABELS)


def client_month_features(timeline: DataFrame, categories: list[str]) -> DataFrame:
    """Month summary with wide counts and minutes, all from one aggregate."""
    table = (
        in_periods(timeline, MONTHS)
        .groupBy(*MONTH_KEYS)
        .agg(*care_columns(), *event_counts(categories), *minute_sums(categories))
    )
    return with_labels(table, SUMMARY_LABELS)


def activity_totals(timeline: DataFrame) -> DataFrame:
    """Minutes per category over all client-months, largest first."""
    months = activity_long(in_periods(timeline, MONTHS), MONTH_KEYS)
    totals = months.groupBy("category").agg(F.sum("mins").alias("total"))
    return totals.orderBy(F.desc("total"), "category")


def client_overview(timeline: DataFrame, categories: list[str]) -> DataFrame:
    """Prior care, follow-up care and follow-up features of clients with follow-up.

    One aggregate by client replaces four aggregates and their joins.
    """
    prior, post = F.col("period").isin(*PRIOR), F.col("period") == FOLLOW_UP
    table = timeline.groupBy("client_id").agg(
        *prior_columns(prior),
        *care_columns(post),
        *event_counts(categories, post),
        *minute_sums(categories, post),
    )
    return with_labels(table.filter(F.col("n").isNotNull()), SUMMARY_LABELS)


def team_minutes(timeline: DataFrame) -> DataFrame:
    """Events and rounded follow-up minutes per client and known team."""
    known = in_periods(timeline, (FOLLOW_UP,)).filter(F.col("team_id").isNotNull())
    return known.groupBy("client_id", "team_id").agg(
        F.sum("n").alias("n"), half_even(F.sum("listed")).alias("mins")
    )


def dominant_team(timeline: DataFrame, teams: DataFrame) -> DataFrame:
    """Team with most minutes per client, the lowest id on a tie, with its names."""
    held = team_minutes(timeline)
    kind = held.schema["team_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"team ids must be whole numbers, not {kind.simpleString()}")
    # Minutes and id as one number of fixed width, so a hash aggregate finds the best: more
    # minutes first, then the lower id. Minutes are whole.
    span = F.lit(Decimal(1 << 64))
    rank = F.lit(Decimal((1 << 63) - 1)) - F.col("team_id").cast("decimal(20,0)")
    packed = (F.col("mins").cast("decimal(17,0)") * span + rank).cast("decimal(38,0)")
    best = held.groupBy("client_id").agg(F.max(packed).alias("best"))
    rest = F.pmod("best", span)
    chosen = best.select(
        "client_id",
        (F.lit(Decimal((1 << 63) - 1)) - rest).cast(kind).alias("team_id"),
        ((F.col("best") - rest) / span).cast("double").alias("team_mins"),
    )
    names = teams.select("team_id", "team", "subdepartment", "department", "organisation")
    return lookup_join(chosen, names, "team_id", "left").select(
        "client_id", "team_id", "team_mins", "team", "subdepartment", "department", "organisation"
    )
