"""Questionnaire scores from a table of scoring rules.

``rules`` holds (rom, item, weight, reverse, top): an answer counts as
``weight * answer``, or ``weight * (top - answer)`` for a reversed item.
``norms`` holds (rom, mean, sd, min_answered). Both are inputs: no published
scoring rule is built in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortline.core.skew import lookup_join
from cohortline.operators.slots import month_of


def raw_scores(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Answered items and raw score per client, date and instrument.

    ``items`` is long: (client_id, date, rom, item, answer). All instruments are
    scored in one aggregate.
    """
    by_item = rules.select("rom", "item", "weight", "reverse", "top")
    points = F.col("weight") * F.when(
        F.col("reverse"), F.col("top") - F.col("answer")
    ).otherwise(F.col("answer"))
    return (
        lookup_join(items, by_item, ["rom", "item"])
        .groupBy("client_id", "date", "rom")
        .agg(F.count("answer").alias("answered"), F.sum(points).alias("raw"))
    )


def t_scores(raw: DataFrame, norms: DataFrame) -> DataFrame:
    """T = 50 + 10 (raw - mean) / sd; missing when too few items are answered."""
    standard = (F.col("raw") - F.col("mean")) / F.col("sd") * 10 + 50
    enough = F.col("answered") >= F.col("min_answered")
    return lookup_join(raw, norms, "rom", "left").withColumn("score", F.when(enough, standard))


def score_instruments(items: DataFrame, rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Dated T-scores of every instrument: (client_id, year, month, date, score, rom)."""
    scored = t_scores(raw_scores(items, rules), norms).filter(F.col("date").isNotNull())
    return month_of(scored).select("client_id", "year", "month", "date", "score", "rom")


def score_instrument(
    items: DataFrame, rules: DataFrame, norms: DataFrame, rom: str
) -> DataFrame:
    """One instrument, from its own item table (client_id, date, item, answer)."""
    return score_instruments(items.withColumn("rom", F.lit(rom)), rules, norms)


def score_bundle(
    tables: dict[str, DataFrame], rules: DataFrame, norms: DataFrame
) -> DataFrame:
    """All instruments of a bundle of item tables, scored together."""
    tagged = [df.withColumn("rom", F.lit(rom)) for rom, df in tables.items()]
    return score_instruments(reduce(DataFrame.unionByName, tagged), rules, norms)


def tag_scores(scored: DataFrame, rom: str) -> DataFrame:
    """Bring a table of (client_id, date, score) to the common score layout."""
    dated = scored.filter(F.col("date").isNotNull()).withColumn("rom", F.lit(rom))
    return month_of(dated)


def score_union(tables: dict[str, DataFrame]) -> DataFrame:
    """All instruments in one table."""
    return reduce(DataFrame.unionByName, [tag_scores(df, rom) for rom, df in tables.items()])


def in_reading_order(scores: DataFrame) -> DataFrame:
    return scores.orderBy("client_id", "year", "month", "rom", "date")
