"""Postcode statistics as a dimension of the patient table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.core.skew import lookup_join
from cohortline.functions.columns import move_first, sentinel_to_null, with_labels

# Source columns, the reserved number, the year read, and labels.
STATISTICS = (
    "PC4",
    "P_NL_ACHTG",
    "P_WE_MIG_A",
    "P_NW_MIG_A",
    "P_HUURWON",
    "P_KOOPWON",
    "M_INKHH",
    "P_LINK_HH",
    "P_HINK_HH",
    "OAD",
    "STED",
)
SENTINEL = -99997
LIVEABILITY_YEAR = 2012
LABELS = {
    "p_nl_achtg": "Percentage Nederlandse achtergrond",
    "p_we_mig_a": "Percentage Westerse Migratieachtergrond",
    "p_nw_mig_a": "Percentage Niet-Westerse Migratieachtergrond",
    "p_huurwon": "Percentage Huurwoningen",
    "p_koopwon": "Percentage Koopwoningen",
    "m_inkhh": "Mediaan Huishoudinkomen",
    "p_link_hh": "Percentage Lage Inkomens Huishoudens",
    "p_hink_hh": "Percentage Hoge Inkomens Huishoudens",
    "oad": "Omgevingsadressendichtheid",
    "sted": "Stedelijkheid",
    "lbrmtr": "Leefbaarheid",
}


def postcode_statistics(raw: DataFrame) -> DataFrame:
    """Chosen statistics in lower case, keyed by zip, reserved number to null."""
    lowered = raw.select(*[F.col(c).alias("zip" if c == "PC4" else c.lower()) for c in STATISTICS])
    return sentinel_to_null(lowered.withColumn("m_inkhh", F.col("m_inkhh").cast("string")), SENTINEL)


def liveability(raw: DataFrame, year: int = LIVEABILITY_YEAR) -> DataFrame:
    """Liveability score of one year, keyed by zip."""
    return raw.filter(F.col("jaar") == year).select(F.col("pc4").alias("zip"), "lbrmtr")


def postcode_dimension(
    statistics: DataFrame, scores: DataFrame, year: int = LIVEABILITY_YEAR
) -> DataFrame:
    """Labelled statistics of every postcode, with its liveability if known."""
    joined = postcode_statistics(statistics).join(liveability(scores, year), "zip", "left")
    return with_labels(joined, LABELS)


def enrich_by_postcode(people: DataFrame, postcode: DataFrame) -> DataFrame:
    """Replace ``zip`` by the statistics of the postcode; unknown ones stay null."""
    front = ["client_id", "gender", "year_of_birth"]
    added = [c for c in postcode.columns if c != "zip"]
    joined = lookup_join(people, postcode, "zip", "left").drop("zip")
    return move_first(joined, *front, *added, "enroll_date")
