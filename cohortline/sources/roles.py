"""The tables a study reads, by role, with the columns each role must offer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

# Required columns by role; further columns are carried along.
ROLE_COLUMNS: dict[str, tuple[str, ...]] = {
    "dx_codes": ("dx_code", "icd9cm_code"),
    "dx": ("client_id", "date", "phase", "ax_1_1"),
    "clients": ("client_id", "date", "gender", "year_of_birth", "zip"),
    "dbc": ("client_id", "date_stop", "claimed"),
    "interventions": (
        "client_id",
        "date",
        "dbc_id",
        "mins_direct_staff",
        "mins_indirect_staff",
        "intervention_type_id",
        "team_id",
    ),
    "intervention_types": ("intervention_type_id", "description_cat"),
    "teams": ("team_id", "team", "subdepartment", "department", "organisation"),
}

DATE_COLUMNS = {"dx": "date", "clients": "date", "dbc": "date_stop", "interventions": "date"}


@dataclass(frozen=True)
class CareTables:
    """Base tables of a study bound to their roles.

    ``interventions`` is a table, or a function that takes a one-column table of
    client ids and reads the events of those clients only.
    """

    dx_codes: DataFrame
    dx: DataFrame
    clients: DataFrame
    dbc: DataFrame
    interventions: DataFrame | Callable[[DataFrame], DataFrame]
    intervention_types: DataFrame
    teams: DataFrame

    def interventions_of(self, client_ids: DataFrame) -> DataFrame:
        if isinstance(self.interventions, DataFrame):
            return self.interventions
        return check_role("interventions", self.interventions(client_ids))


def check_role(role: str, df: DataFrame) -> DataFrame:
    """Return ``df`` with its role's date column as a date; fail on missing columns."""
    missing = [c for c in ROLE_COLUMNS[role] if c not in df.columns]
    if missing:
        raise ValueError(f"{role} lacks columns {missing}")
    date = DATE_COLUMNS.get(role)
    if date and not isinstance(df.schema[date].dataType, T.DateType):
        df = df.withColumn(date, df[date].cast("date"))
    return df


def bind(**tables: DataFrame | Callable[[DataFrame], DataFrame]) -> CareTables:
    """Check each table against its role and bind all of them."""
    return CareTables(
        **{
            role: check_role(role, given) if isinstance(given, DataFrame) else given
            for role, given in tables.items()
        }
    )
