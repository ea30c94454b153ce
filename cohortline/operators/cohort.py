"""Cohort selection around an index diagnosis."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.skew import lookup_join
from cohortline.core.spec import CohortSpec
from cohortline.functions.aggregates import first_per_group, sum_or_zero
from cohortline.functions.columns import move_first


def target_codes(dx_codes: DataFrame, pattern: str, major: str | None = None) -> DataFrame:
    """Distinct diagnosis codes whose classification code matches ``pattern``.

    ``major`` also asks for a major diagnosis group.
    """
    matching = dx_codes.filter(F.col("icd9cm_code").rlike(pattern))
    if major is not None:
        matching = matching.filter(F.col("major_nl") == major)
    return matching.select("dx_code").distinct()


def qualifying_diagnoses(dx: DataFrame, spec: CohortSpec) -> DataFrame:
    """Diagnoses in an index phase, recorded in the first year or later."""
    start = F.lit(dt.date(spec.first_year, 1, 1))
    return dx.filter(F.col("phase").isin(*spec.phases)).filter(F.col("date") >= start)


def first_diagnosis(dx: DataFrame, spec: CohortSpec) -> DataFrame:
    """First qualifying diagnosis of each client, whatever its code."""
    found = first_per_group(
        qualifying_diagnoses(dx, spec),
        ["client_id"],
        ["date", *spec.tie_break],
        ["ax_1_1", "date"],
    )
    return found.select("client_id", F.col("ax_1_1").alias("dx"), F.col("date").alias("dx_date"))


def index_event(dx: DataFrame, dx_codes: DataFrame, spec: CohortSpec) -> DataFrame:
    """Clients whose *first* qualifying diagnosis is a target; code tested last."""
    targets = target_codes(dx_codes, spec.code_pattern).withColumnRenamed("dx_code", "dx")
    found = lookup_join(first_diagnosis(dx, spec), targets, "dx", "left_semi")
    return found.select("client_id", "dx", "dx_date")


def followed_up(spec: CohortSpec) -> Column:
    return F.datediff(F.lit(spec.as_of), F.col("dx_date")) >= spec.follow_up_days


def enrolled_by_index() -> Column:
    return F.col("enroll_date").isNotNull() & (F.col("dx_date") >= F.col("enroll_date"))


def client_attributes(clients: DataFrame) -> DataFrame:
    return clients.select(
        "client_id", F.col("date").alias("enroll_date"), "gender", "year_of_birth", "zip"
    )


def index_cohort(
    dx: DataFrame, dx_codes: DataFrame, clients: DataFrame, spec: CohortSpec
) -> DataFrame:
    """Index clients with enough follow-up who enrolled on or before the index date."""
    joined = index_event(dx, dx_codes, spec).join(client_attributes(clients), "client_id", "left")
    kept = joined.filter(followed_up(spec)).filter(enrolled_by_index())
    return move_first(kept, "client_id", "gender", "year_of_birth", "enroll_date")


def newest_first(cohort: DataFrame) -> DataFrame:
    """Cohort ordered for output, latest enrolment first."""
    return cohort.orderBy(F.col("enroll_date").desc_nulls_last(), "client_id")


def episode_costs(dbc: DataFrame, index: DataFrame, kind: str | None = None) -> DataFrame:
    """Claimed cost of episodes that ended after the index date, per client.

    All episode types count unless ``kind`` names one.
    """
    if kind is not None:
        dbc = dbc.filter(F.col("GGZ_type") == kind)
    closed = dbc.filter(F.col("date_stop").isNotNull()).select("client_id", "date_stop", "claimed")
    joined = lookup_join(closed, index.select("client_id", "dx_date"), "client_id")
    later = joined.filter(F.col("date_stop") > F.col("dx_date"))
    return later.groupBy("client_id").agg(sum_or_zero(F.col("claimed")).alias("costs"))


def attrition(
    dx: DataFrame,
    dx_codes: DataFrame,
    clients: DataFrame,
    costs: DataFrame,
    follow_up: DataFrame,
    spec: CohortSpec,
) -> DataFrame:
    """Rows left after each narrowing step: (step, name, remaining).

    ``costs`` and ``follow_up`` hold one row per client; ``follow_up`` carries
    ``days``, ``n`` and ``mins``; ``clients`` has one row per client too. The
    diagnoses are read once: rows and first diagnoses come from one aggregate.
    """
    in_years = F.col("date") >= F.lit(dt.date(spec.first_year, 1, 1))
    seen = first_per_group(
        dx.filter(F.col("phase").isin(*spec.phases)),
        ["client_id"],
        ["date", *spec.tie_break],
        ["ax_1_1", "date"],
        where=in_years,
        also={"_in_phase": F.count(F.lit(1)), "_in_years": F.count_if(in_years)},
    ).withColumnsRenamed({"ax_1_1": "dx", "date": "dx_date"})

    targets = target_codes(dx_codes, spec.code_pattern).select(
        F.col("dx_code").alias("dx"), F.lit(True).alias("_target")
    )
    people = lookup_join(seen, targets, "dx", "left")
    people = (
        people.join(client_attributes(clients), "client_id", "left")
        .join(costs.select("client_id", F.lit(True).alias("_costs")), "client_id", "left")
        .join(follow_up.select("client_id", "days", "n", "mins"), "client_id", "left")
    )
    served = (
        (F.col("days") >= spec.min_days)
        & (F.col("n") >= spec.min_events)
        & (F.col("mins") >= spec.min_minutes)
    )
    tests = {
        "first_diagnosis": F.col("_in_years") > 0,
        "target_code": F.col("_target").isNotNull(),
        "followed_up": followed_up(spec),
        "enrolled": enrolled_by_index(),
        "closed_episode": F.col("_costs").isNotNull(),
        "care_after_index": F.col("n").isNotNull(),
        "enough_care": served,
    }
    passed = F.lit(True)
    counts = [sum_or_zero(F.col(f"_{n}")).alias(n) for n in ("in_phase", "in_years")]
    for name, test in tests.items():
        passed = passed & test
        counts.append(F.count_if(passed).alias(name))
    return _as_steps(people.agg(*counts), ["in_phase", "in_years", *tests])


def _as_steps(one_row: DataFrame, names: list[str]) -> DataFrame:
    """Turn the columns of a one-row table into (step, name, remaining) rows."""
    steps = [
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("remaining"))
        for i, n in enumerate(names, 1)
    ]
    return one_row.select(F.inline(F.array(*steps)))
