"""From base tables to the patient table and the patient-month table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cohortline.core.skew import measured
from cohortline.core.spec import CohortSpec
from cohortline.core.workspace import materialise
from cohortline.functions.columns import named
from cohortline.operators.cohort import episode_costs, index_cohort
from cohortline.operators.sampling import exact_sample
from cohortline.operators.summaries import client_month_features, client_overview, dominant_team
from cohortline.operators.timeline import category_values, compact, event_timeline
from cohortline.sources.roles import CareTables


@dataclass(frozen=True)
class Study:
    """Stored cohort and compacted timeline of one study."""

    care: CareTables
    spec: CohortSpec
    cohort: DataFrame
    cells: DataFrame
    categories: list[str]


def stored_cohort(care: CareTables, spec: CohortSpec) -> DataFrame:
    """The cohort, computed once: every later step reads it."""
    return materialise(index_cohort(care.dx, care.dx_codes, care.clients, spec), "cohort")


def cohort_timeline(
    care: CareTables, cohort: DataFrame, spec: CohortSpec, categories: bool = True
) -> DataFrame:
    """Events of the cohort on its clock; categories are looked up if wanted."""
    events = care.interventions_of(cohort.select("client_id"))
    derived = not isinstance(care.interventions, DataFrame)
    types = care.intervention_types if categories else None
    return event_timeline(events, types, cohort, spec, derived)


def start_study(care: CareTables, spec: CohortSpec) -> Study:
    """Store the cohort and its compacted events; one pass over the events."""
    cohort = stored_cohort(care, spec)
    cells = materialise(compact(cohort_timeline(care, cohort, spec)), "cells")
    return Study(care, spec, cohort, cells, category_values(care.intervention_types))


def enough_care(patients: DataFrame, spec: CohortSpec) -> DataFrame:
    """Drop patients with very little care; unknown minutes do not pass."""
    return patients.filter(
        (F.col("days") >= spec.min_days)
        & (F.col("n") >= spec.min_events)
        & (F.col("mins") >= spec.min_minutes)
    )


def assemble_patients(study: Study) -> DataFrame:
    """One row per patient: attributes, costs, prior care, care, team, features."""
    care, cells = study.care, study.cells
    costs = episode_costs(care.dbc, study.cohort)
    overview = client_overview(cells, study.categories)
    served = study.cohort.join(costs, "client_id").join(overview, "client_id")
    patients = served.join(dominant_team(cells, care.teams), "client_id", "left")
    features = [f"{p}_{c}" for p in ("n", "mins") for c in study.categories]
    ordered = [c for c in patients.columns if c not in features] + features
    return enough_care(patients.select(*[named(c) for c in ordered]), study.spec)


def patient_months(study: Study) -> DataFrame:
    """Care per client-month of the whole cohort, selected or not."""
    return client_month_features(study.cells, study.categories)


def case_bundle(tables: dict[str, DataFrame], clients: DataFrame) -> dict[str, DataFrame]:
    """All rows of the given clients from every table."""
    ids = measured(clients.select("client_id").distinct(), "client_id")
    return {name: ids.join(df, "left_semi") for name, df in tables.items()}


def demo_clients(clients: DataFrame, count: int = 10, seed: int = 0) -> DataFrame:
    """A repeatable draw of exactly ``count`` clients (or all) for a demonstration bundle."""
    ids = clients.select("client_id").filter("client_id is not null").distinct()
    return exact_sample(materialise(ids, "clients"), "client_id", count, f"{seed}/")
