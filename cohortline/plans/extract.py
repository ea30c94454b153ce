"""The anonymised research extract: four tables, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortline.core.spec import CohortSpec
from cohortline.core.workspace import materialise
from cohortline.operators.postcode import enrich_by_postcode
from cohortline.operators.privacy import pseudonymise
from cohortline.operators.slots import diagnosis_months_wide, score_months_wide
from cohortline.plans.patients import (
    Study,
    assemble_patients,
    case_bundle,
    patient_months,
    start_study,
)
from cohortline.plans.trajectories import patients_with_clusters
from cohortline.sources.roles import CareTables
from cohortline.sources.tables import publish_tables


def build_extract(
    care: CareTables,
    scores: DataFrame,
    postcode: DataFrame,
    keys: DataFrame,
    spec: CohortSpec,
    diagnosis_order: tuple[str, ...] = ("date",),
    on_missing: str = "keep",
    **clustering,
) -> dict[str, DataFrame]:
    """The four output tables by name, with keys in the place of client ids.

    ``scores`` holds dated instrument scores (client_id, year, month, date,
    score, rom) of any clients; those of the selected patients are used. The
    month table covers the whole cohort, selected or not.
    """
    study = start_study(care, spec)
    selected = materialise(assemble_patients(study), "patients")
    patients = enrich_by_postcode(patients_with_clusters(selected, **clustering), postcode)
    tables = {"patients": patients} | month_tables(study, selected, scores, diagnosis_order)
    return {name: pseudonymise(df, keys, on_missing) for name, df in tables.items()}


def month_tables(
    study: Study, selected: DataFrame, scores: DataFrame, diagnosis_order: tuple[str, ...]
) -> dict[str, DataFrame]:
    """The three month tables by name, still with client ids."""
    bundle = case_bundle({"scores": scores, "dx": study.care.dx}, selected)
    return {
        "patient_months_interventions": patient_months(study),
        "patient_months_diagnoses": diagnosis_months_wide(bundle["dx"], diagnosis_order),
        "patient_months_romscores": score_months_wide(bundle["scores"]),
    }


ORDER = ("client_id", "year", "month")


def in_total_order(df: DataFrame) -> DataFrame:
    """Rows by client, year and month over all partitions: each holds a range and is sorted.

    Files are written by partition, so reading them by name gives the whole table in order.
    """
    keys = [c for c in ORDER if c in df.columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def with_position(df: DataFrame) -> DataFrame:
    """Stored rows in total order with their ``position`` from 1; only range counts are gathered."""
    laid = in_total_order(df).withColumn("_id", F.monotonically_increasing_id())
    stored = materialise(laid, "ordered").withColumn("_range", F.shiftright("_id", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, as many as there are partitions.
    ranges = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return stored.join(F.broadcast(ranges), "_range").withColumn("position", place).drop("_id", "_range", "_before")


def write_extract(tables: dict[str, DataFrame], folder: str, by_year: bool = False) -> None:
    """Write the four tables in total order, and publish them together.

    Each run writes to a folder of its own below ``folder``. Only when all tables are complete the
    manifest is replaced, in one step, and from then on names that run. A failed run leaves what
    was published before. ``by_year`` lays months out by year, in order within each year.
    """
    months = [name for name, df in tables.items() if "year" in df.columns]
    ordered = {name: in_total_order(df) for name, df in tables.items()}
    publish_tables(ordered, folder, {name: ["year"] for name in months} if by_year else None)
