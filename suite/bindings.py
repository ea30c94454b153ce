"""Study roles bound to the star-schema test tables.

Missing values, unknown categories, sentinels and ties are put in on purpose,
by expressions over the columns; every table is read whole.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.core.skew import lookup_join
from cohortline.core.spec import CohortSpec
from cohortline.sources.roles import CareTables, bind

SPEC = CohortSpec(
    code_pattern="1-URGENT|2-HIGH",
    phases=("O", "F"),
    first_year=1996,
    as_of=dt.date(2001, 8, 1),
    tie_break=("o_orderkey",),
)

INSTRUMENTS = ("click", "error", "purchase", "signup", "view")
AXES = ("ax_1_1", "ax_1_2", "ax_1_3", "ax_1_4", "ax_2_1", "ax_2_2")


# Declared schemas: no footer is read to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def dx_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("dx_code"))
    return codes.distinct().withColumn("icd9cm_code", F.col("dx_code"))


def dx(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    none = F.lit(None).cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderstatus").alias("phase"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("ax_1_1"),
        F.when(price > 400000, F.col("o_orderpriority")).alias("ax_1_2"),
        none.alias("ax_1_3"),
        none.alias("ax_1_4"),
        F.when(price > 300000, F.col("o_orderstatus")).alias("ax_2_1"),
        none.alias("ax_2_2"),
        none.alias("ax_3"),
        F.when(price > 200000, F.lit("yes")).alias("ax_4"),
        F.when(price >= 50000, price).alias("gaf1"),
        F.lit(None).cast("double").alias("gaf2"),
        "o_orderkey",
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    enrolled = F.date_add(F.lit(dt.date(1995, 1, 1)), F.pmod(key * 37, F.lit(900)).cast("int"))
    return table(spark, folder, "customer").select(
        key.alias("client_id"),
        F.when(F.col("c_acctbal") >= 0, enrolled).alias("date"),
        F.col("c_mktsegment").alias("gender"),
        (F.lit(1940) + F.pmod(key, F.lit(60))).cast("int").alias("year_of_birth"),
        F.col("c_nationkey").alias("zip"),
    )


def dbc(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("client_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("date_stop"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("claimed"),
    )


def interventions(
    spark: SparkSession, folder: str, client_ids: DataFrame | None = None
) -> DataFrame:
    """Line items as events of the ordering customer, of all or of given clients."""
    owners = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client_id")
    )
    if client_ids is not None:
        owners = lookup_join(owners, client_ids, "client_id", "left_semi")
    unknown = (F.col("l_quantity") == 50) & (F.col("l_discount") < 0.005)
    flag = F.col("l_returnflag")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(flag == "A", -1).when(flag == "R", 1).cast("long").alias("dbc_id"),
        F.when(~unknown, F.col("l_quantity")).alias("mins_direct_staff"),
        F.col("l_linenumber").cast("double").alias("mins_indirect_staff"),
        F.col("l_partkey").alias("intervention_type_id"),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("team_id"),
    )
    return lookup_join(lines, owners, "l_orderkey").drop("l_orderkey")


def intervention_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("intervention_type_id"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_type")).alias("description_cat"),
    )


def teams(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = table(spark, folder, "supplier").join(
        places, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("s_suppkey").alias("team_id"),
        F.col("s_name").alias("team"),
        F.col("n_name").alias("subdepartment"),
        F.concat(F.lit("dept "), F.col("n_regionkey").cast("string")).alias("department"),
        F.col("r_name").alias("organisation"),
    )


def care_tables(spark: SparkSession, folder: str) -> CareTables:
    return bind(
        dx_codes=dx_codes(spark, folder),
        dx=dx(spark, folder),
        clients=clients(spark, folder),
        dbc=dbc(spark, folder),
        interventions=lambda ids: interventions(spark, folder, ids),
        intervention_types=intervention_types(spark, folder),
        teams=teams(spark, folder),
    )


# --- scores and diagnoses -----------------------------------------------------


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events as instrument scores: (client_id, year, month, date, score, rom, …)."""
    day = F.col("ts").cast("date")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("client_id"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        day.alias("date"),
        F.col("value").alias("score"),
        F.col("event_type").alias("rom"),
        "ts",
        "event_id",
    )


def score_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table per instrument, as separately scored questionnaires arrive."""
    every = scores(spark, folder).select("client_id", "date", "score", "rom")
    return {rom: every.filter(F.col("rom") == rom).drop("rom") for rom in INSTRUMENTS}


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Events as questionnaire answers: (client_id, date, rom, item, answer)."""
    number = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("client_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("rom"),
        F.pmod(number, F.lit(10)).alias("item"),
        F.col("value").alias("answer"),
    )


# Scoring inputs of the test study, not of any published questionnaire.
RULES = [
    (rom, item, 1.0 + item % 3, item in (3, 7), 500.0) for rom in INSTRUMENTS for item in range(10)
]
NORMS = [(rom, 100.0 + 10 * i, 20.0 + i, 2) for i, rom in enumerate(INSTRUMENTS)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "rom string, item int, weight double, reverse boolean, top double"
    )


def norms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NORMS, "rom string, mean double, sd double, min_answered int")


# --- postcodes and keys ---------------------------------------------------------

SEGMENT_COLUMNS = {
    "P_NL_ACHTG": "BUILDING",
    "P_WE_MIG_A": "FURNITURE",
    "P_NW_MIG_A": "MACHINERY",
    "P_HUURWON": "HOUSEHOLD",
    "P_KOOPWON": "AUTOMOBILE",
}


def postcode_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by nation as area statistics; small shares are suppressed."""

    def share(test):
        percent = F.floor(F.count_if(test) * 100 / F.count(F.lit(1))).cast("double")
        return F.when(percent < 19, F.lit(-99997.0)).otherwise(percent)

    balance = F.col("c_acctbal")
    return table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("PC4")).agg(
        *[share(F.col("c_mktsegment") == v).alias(c) for c, v in SEGMENT_COLUMNS.items()],
        F.pmod(F.count(F.lit(1)), F.lit(4)).alias("M_INKHH"),
        share(balance < 0).alias("P_LINK_HH"),
        share(balance > 5000).alias("P_HINK_HH"),
        F.count(F.lit(1)).cast("double").alias("OAD"),
        F.count_if(balance > 9000).cast("double").alias("STED"),
    )


def liveability(spark: SparkSession, folder: str) -> DataFrame:
    years = F.explode(F.array(F.lit(2011), F.lit(2012))).alias("jaar")
    counted = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("pc4"), years)
    return counted.groupBy("pc4", "jaar").agg(
        ((F.count(F.lit(1)) + F.col("jaar")) / 10).alias("lbrmtr")
    )


def client_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all customers; one segment has no key."""
    known = F.col("c_mktsegment") != "HOUSEHOLD"
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.when(known, F.md5(F.col("c_custkey").cast("string"))).alias("key"),
    )


# --- given clusters -------------------------------------------------------------


def labelled_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with nested labels: segment, and segment with region."""
    nation = table(spark, folder, "nation")
    joined = table(spark, folder, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    region = F.col("n_regionkey").cast("string")
    return joined.select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_mktsegment").alias("coarse"),
        F.concat_ws(".", "c_mktsegment", region).alias("fine"),
        F.col("c_acctbal").alias("measure"),
    )


def labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("x"), "label"
    )


def nested_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """(label, k, cut): labels of the vectors joined in twos, fours and so on; k counts the clusters."""
    finest = table(spark, folder, "embeddings").select("label").filter("label is not null").distinct()
    found = []
    for width in (1, 2, 4):
        joined = finest.select("label", F.floor(F.col("label") / width).cast("int").alias("cut"))
        count = joined.agg(F.countDistinct("cut")).first()[0]
        found.append(joined.withColumn("k", F.lit(count)))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["label", "k"])


def gender_profiles(patients: DataFrame, dims: list[str]) -> DataFrame:
    """(anchor_id, x): the mean minutes per category of each gender, in whole minutes."""
    means = [F.round(F.avg(F.col(f"`mins_{d}`"))) for d in dims]
    known = patients.filter("gender is not null")
    return known.groupBy(F.col("gender").cast("string").alias("anchor_id")).agg(F.array(*means).alias("x"))
